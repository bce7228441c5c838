"""Exact substring dedup with difference-cover anchors.

A window is WINDOW consecutive words. Its first occurrence, by document id, stays; in later documents its words go.
Hashing every window would shuffle one row a word. Instead only runs of ANCHOR words are hashed whose start, modulo
PERIOD, lies in the difference cover COVER: for any two positions i and j there is a shift d < PERIOD that puts both
i + d and j + d into the cover, so two equal windows always share an anchor at the same place inside them. Repeated
anchors are then extended to the windows around them, and these are compared whole by 128-bit hash.

Three passes over the texts, one shuffle of them and two of hashes. Hashes travel in blobs: one row for each batch and
hash bucket, unpacked by NumPy bucket by bucket. Anchors need not be exact, so they carry 48 bits of hash. An occurrence
that its own batch already decides goes to a bucket by document instead of by hash, so a hash sends one document's
entries per batch to its bucket, however common it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.base import buckets_for, forget, prepare

WINDOW = 13
PERIOD = 7
#: Every difference modulo 7 is a difference of two of these.
COVER = (0, 1, 3)
#: A window holds PERIOD shifts of an anchor of this length.
ANCHOR = WINDOW - PERIOD + 1

#: Bytes of input whose texts one task of the later passes gets.
TASK_BYTES = 16 << 20

_NULL_ID = np.iinfo(np.int64).max
_FIELDS = {"hi": np.uint64, "lo": np.uint64, "id": np.int64, "key": np.int64, "at": np.uint32, "sure": np.uint8}


def _pack(e: dict[str, np.ndarray], pick: np.ndarray, wide: bool) -> bytes:
    """Entries of one bucket, documents in a table of their own; narrow entries have 48 bits of hash and no id."""
    key, at, hi = e["key"][pick], e["at"][pick], e["hi"][pick]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    parts = [np.array([len(key), len(first)], "<u4"), key[first], count.astype("<u4"), (at & 0xFFFF).astype("<u2"), (at >> 16).astype("<u2"), e["sure"][pick]]
    parts += [e["id"][pick][first], hi, e["lo"][pick]] if wide else [np.ascontiguousarray(hi.view(np.uint8).reshape(-1, 8)[:, :6])]
    return b"".join([x.tobytes() for x in parts])


def _unpack(blobs: list[bytes], wide: bool) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {f: [] for f in _FIELDS}
    for blob in blobs:
        at = 8
        n, docs = np.frombuffer(blob, "<u4", 2).tolist()

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(blob, kind, count, at)  # noqa: B023
            at += x.nbytes
            return x

        key, count = take("<i8", docs), take("<u4", docs)
        low, high = take("<u2", n), take("<u2", n)
        parts["at"].append(low.astype(np.uint32) | high.astype(np.uint32) << np.uint32(16))
        parts["sure"].append(take("u1", n))
        parts["key"].append(np.repeat(key, count))
        if wide:
            parts["id"].append(np.repeat(take("<i8", docs), count))
            parts["hi"].append(take("<u8", n))
            parts["lo"].append(take("<u8", n))
        else:
            hi = np.zeros((n, 8), np.uint8)
            hi[:, :6] = take("u1", 6 * n).reshape(n, 6)
            parts["id"].append(parts["key"][-1])
            parts["hi"].append(hi.view("<u8").ravel())
            parts["lo"].append(np.zeros(n, np.uint64))
    return {f: np.concatenate(x) if x else np.empty(0, _FIELDS[f]) for f, x in parts.items()}


def _runs(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by (hash, id) and the number of each ordered entry's hash."""
    order = np.lexsort((e["id"], e["lo"], e["hi"]))
    hi, lo = e["hi"][order], e["lo"][order]
    new = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])] if len(hi) else np.empty(0, bool)
    return order, np.cumsum(new) - 1


def _first_and_last(e: dict[str, np.ndarray], order: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest id of each ordered entry's hash."""
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    end = np.r_[start[1:], len(run)] - 1
    ids = e["id"][order]
    return ids[start][run], ids[end][run]


def _decide(e: dict[str, np.ndarray], shared: bool) -> np.ndarray:
    """Which entries are decided by the entries given. shared: their hash is in two documents; else: a smaller id has it."""
    sure = np.zeros(len(e["hi"]), bool)
    if len(sure):
        order, run = _runs(e)
        first, last = _first_and_last(e, order, run)
        sure[order] = first != last if shared else e["id"][order] > first
    return sure | (e["sure"] > 0)


def _emit(e: dict[str, np.ndarray], buckets: int, shared: bool, wide: bool):
    """Blobs of one batch's entries by bucket, after the batch has decided what it can."""
    if not len(e["hi"]):
        return
    sure = _decide(e, shared)
    order, run = _runs(e)
    first, _ = _first_and_last(e, order, run)
    lowest = np.empty(len(sure), bool)
    lowest[order] = e["id"][order] == first
    aside = sure & ~lowest
    by = np.where(aside, xx(e["id"].astype(np.uint64) ^ e["key"].view(np.uint64)), e["hi"]) % np.uint64(buckets)
    e = e | {"sure": sure.astype(np.uint8) + (aside.astype(np.uint8) << 1)}
    at = np.argsort(by, kind="stable")
    edges = np.flatnonzero(np.r_[True, by[at][1:] != by[at][:-1]])
    rows = [(int(by[at[s]]), _pack(e, at[s:t], wide)) for s, t in zip(edges, np.r_[edges[1:], len(at)], strict=True)]
    yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def xx(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of uint64 values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _gather(ids: list, keys: list, hashes: list[np.ndarray], lows: list[np.ndarray] | None, places: list[np.ndarray]) -> dict[str, np.ndarray]:
    n = [len(x) for x in places]
    hi = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return {
        "hi": hi,
        "lo": np.concatenate(lows) if lows else np.zeros(len(hi), np.uint64),
        "id": np.repeat(np.array(ids, np.int64), n),
        "key": np.repeat(np.array(keys, np.int64), n),
        "at": np.concatenate(places).astype(np.uint32) if places else np.empty(0, np.uint32),
        "sure": np.zeros(len(hi), np.uint8),
    }


def _anchor_batches(buckets: int):
    def run(batches):
        forget()
        for batch in batches:
            keys, who, hashes, places = batch.column(0).to_pylist(), [], [], []
            for key, text in zip(keys, batch.column(1).cast(pa.binary()), strict=True):
                words = _words(text.as_py())
                if len(words) < WINDOW:
                    continue
                at = np.arange(len(words) - ANCHOR + 1)
                at = at[np.isin(at % PERIOD, COVER)]
                grams = (b" ".join(words[p : p + ANCHOR]) for p in at.tolist())
                hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(at)))
                places.append(at)
                who.append(key)
            yield from _emit(_gather(who, who, hashes, None, places), buckets, shared=True, wide=False)

    return run


def _answers(shared: bool, wide: bool):
    """One bucket's entries: those that are decided, as rows (id, key, places)."""

    def run(group: pa.Table) -> pa.Table:
        e = _unpack(group.column("blob").to_pylist(), wide)
        aside = e["sure"] > 1
        here = {f: x[~aside] for f, x in e.items()}
        yes = np.concatenate([np.flatnonzero(~aside)[_decide(here, shared)], np.flatnonzero(aside)])
        ids, keys, at = e["id"][yes], e["key"][yes], e["at"][yes]
        order = np.lexsort((at, keys, ids))
        ids, keys, at = ids[order], keys[order], at[order]
        edges = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]) if len(ids) else np.empty(0, int)
        blobs = [at[s:t].astype("<u4").tobytes() for s, t in zip(edges, np.r_[edges[1:], len(ids)], strict=True)] if len(ids) else []
        return pa.table({"id": pa.array(ids[edges], pa.int64()), "key": pa.array(keys[edges], pa.int64()), "places": pa.array(blobs, pa.binary())})

    return run


def _places(found: list[dict] | None, own: int | None = None) -> np.ndarray:
    """The places said of this row, or of any row of its key."""
    blobs = [f["places"] for f in found or [] if own is None or f["id"] == own]
    return np.unique(np.frombuffer(b"".join(blobs), "<u4")).astype(np.int64)


def _own(batch: pa.RecordBatch, id_col: str) -> list[int]:
    return [_NULL_ID if x is None else x for x in batch.column(id_col).to_pylist()]


def _window_batches(buckets: int, id_col: str, text_col: str):
    def run(batches):
        for batch in batches:
            keys, ids, found = batch.column(_KEY).to_pylist(), _own(batch, id_col), batch.column(_SAID).to_pylist()
            who, highs, lows, places = [], [], [], []
            for i, text in enumerate(batch.column(text_col).cast(pa.binary())):
                words = _words(text.as_py())
                at = _places(found[i])
                starts = np.unique((at[:, None] - np.arange(PERIOD)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts <= len(words) - WINDOW)]
                if not len(starts):
                    continue
                raw = b"".join([xxhash.xxh3_128_digest(b" ".join(words[p : p + WINDOW])) for p in starts.tolist()])
                pair = np.frombuffer(raw, "<u8").reshape(-1, 2)
                highs.append(pair[:, 0])
                lows.append(pair[:, 1])
                places.append(starts)
                who.append(i)
            yield from _emit(_gather([ids[i] for i in who], [keys[i] for i in who], highs, lows, places), buckets, shared=False, wide=True)

    return run


def _left(words: list[bytes], at: np.ndarray) -> list[bytes]:
    """The words that no window of these starts covers."""
    if not len(at):
        return words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + WINDOW, len(words)), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


_KEY, _SAID = "__key", "__said"


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the starts of the windows to remove in _SAID.

    Rows are found again by a hash of id and text; where two rows' hashes are equal, the ids tell whose the starts are.
    Both passes that need texts again read one shuffle of them.
    """
    prepare(docs.sparkSession)
    buckets = buckets_for(docs, 12 << 20)
    plain = docs.withColumn(_KEY, F.xxhash64(F.col(id_col), F.col(text_col)))
    # explicit numbers of partitions, which grow with the input: a task gets a bucket or two, or about TASK_BYTES of texts
    rows = plain.repartition(buckets_for(docs, TASK_BYTES), _KEY)

    def asked(entries: DataFrame, shared: bool, wide: bool) -> DataFrame:
        said = entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answers(shared, wide), "id bigint, key bigint, places binary")
        return said.groupBy("key").agg(F.collect_list(F.struct("id", "places")).alias(_SAID)).withColumnRenamed("key", "__k")

    blobs = "bucket bigint, blob binary"
    anchors = asked(plain.select(_KEY, F.col(text_col)).mapInArrow(_anchor_batches(buckets), blobs), True, False)
    near = rows.join(anchors, rows[_KEY] == anchors["__k"]).drop("__k")
    windows = asked(near.mapInArrow(_window_batches(buckets, id_col, text_col), blobs), False, True)
    return rows.join(windows, rows[_KEY] == windows["__k"], "left").drop("__k")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of ``docs``.

    Ids are of an integer type. A null or empty text has no words. A null id counts as larger than every other id, and
    rows of equal id, nulls included, never remove words from each other; repeated rows give repeated results. Other
    columns of ``docs`` are not looked at. An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            found, total, removed, kept = batch.column(_SAID).to_pylist(), [], [], []
            for i, (own, text) in enumerate(zip(_own(batch, "doc_id"), batch.column("text").cast(pa.binary()), strict=True)):
                words = _words(text.as_py())
                left = _left(words, _places(found[i], own))
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _judged(rows, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated windows' words taken out of the texts; a text that loses none is left as it is.

    All rows and columns stay; a text that loses all its words becomes empty.
    """
    schema = docs.schema

    def run(batches):
        for batch in batches:
            found, texts = batch.column(_SAID).to_pylist(), batch.column(text_col).cast(pa.binary()).to_pylist()
            for i, own in enumerate(_own(batch, id_col)):
                at = _places(found[i], own)
                if len(at):
                    texts[i] = b" ".join(_left(_words(texts[i]), at))
            columns = [pa.array(texts, pa.binary()).view(pa.string()) if n == text_col else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return _judged(docs, id_col, text_col).mapInArrow(run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``; see deduplicated()."""
    return deduplicated(docs, id_col, text_col).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    """The same results by comparing all windows, for tests."""
    split = [(i, _words(t.encode() if t else None)) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, words in split:
        for p in range(len(words) - WINDOW + 1):
            w = tuple(words[p : p + WINDOW])
            first[w] = min(i, first.get(w, i))
    out = []
    for i, words in split:
        gone = {q for p in range(len(words) - WINDOW + 1) if first[tuple(words[p : p + WINDOW])] < i for q in range(p, p + WINDOW)}
        kept = b" ".join(w for q, w in enumerate(words) if q not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
