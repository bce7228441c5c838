"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. Two fingerprints' Hamming distance
is at least the Manhattan distance of their count vectors. Written in unary (0 = 00, 1 = 01, 2 = 11) the vector is
again 64 bits, and the Manhattan distance is the popcount of an XOR. The vector has two halves of 16 segments; if
the whole distance is at most 3, one half differs by at most 1. So the grid has one cell for each value of a half,
and a fingerprint is compared with those in its own cell and in the cells one step up (the pair's other member makes
the same step down). Candidates are then verified by exact Hamming distance.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.base import forget, prepare, small
from quantloom.llm.graph import components

SEED = 42
BITS = 64
MAX_DISTANCE = 3
SHINGLE = 3
#: Fingerprints of one cell that one task compares; a cell with more is split over several tasks.
CELL_ROWS = 20_000
#: Runs up to this length are compared pair by pair at once for a whole batch; longer ones by a search that emits
#: one link for each fingerprint it reaches.
SHORT_RUN = 24
_CHUNK = 1 << 16
_EVEN = np.uint64(0x5555555555555555)
_HALF = np.uint64(0xFFFFFFFF)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, repeats included; a text of fewer words is one shingle, of none none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - shingle + 1))


def bits_of(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text as an unsigned integer; of no words, 0."""
    return bits_of(shingle_hashes(text, shingle))


def _fingerprint_batches(batches):
    forget()
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long. One pass, no shuffle."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp bigint")


def unary_counts(fps: np.ndarray) -> np.ndarray:
    """The segment-popcount vectors of uint64 fingerprints in unary."""
    low, high = fps & _EVEN, (fps >> np.uint64(1)) & _EVEN
    return (low | high) | ((low & high) << np.uint64(1))


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, kind, index into fps) of all grid entries; kind 0 is the own cell, kind 1 a cell one step up."""
    code = unary_counts(fps)
    keys, kinds, who = [], [], []
    index = np.arange(len(fps))
    for half in (0, 1):
        c = (code >> np.uint64(32 * half)) & _HALF
        tag = np.uint64(half << 32)
        keys.append(c | tag)
        kinds.append(np.zeros(len(fps), np.int8))
        who.append(index)
        for i in range(16):
            first, second = np.uint64(1 << (2 * i)), np.uint64(2 << (2 * i))
            can = (c & second) == 0
            up = np.where((c & first) == 0, c | first, c | second)[can]
            keys.append(up | tag)
            kinds.append(np.ones(len(up), np.int8))
            who.append(index[can])
    return np.concatenate(keys), np.concatenate(kinds), np.concatenate(who)


def _cell_batches(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        key, kind, who = cells(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(kind), pa.array(fps[who])], ["cell", "kind", "fp"])


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The lower bound first, then the exact distance."""
    bound = np.bitwise_count(unary_counts(a) ^ unary_counts(b)) <= most
    return bound & (np.bitwise_count(a ^ b) <= most)


def _search(own: np.ndarray, other: np.ndarray, most: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what pairs of one run connect that have an own entry: breadth first, at most one link for each
    fingerprint reached. Own entries are compared with all that is left, others with the own ones that are left.
    ``seen`` counts comparisons."""
    own = np.unique(own)
    fps = np.r_[own, np.setdiff1d(other, own)]
    left = np.ones(len(fps), bool)
    a, b = [], []
    for start in range(len(own)):
        if not left[start]:
            continue
        left[start] = False
        front = np.array([start])
        while len(front):
            found = []
            for part, rest in ((front[front < len(own)], len(fps)), (front[front >= len(own)], len(own))):
                for at in range(0, len(part), 64):
                    open_ = np.flatnonzero(left[:rest])
                    if not len(open_):
                        break
                    now = part[at : at + 64]
                    near = _close(fps[now][:, None], fps[open_][None, :], most)
                    if seen is not None:
                        seen.append(near.size)
                    hit = near.any(axis=0)
                    new = open_[hit]
                    a.append(fps[now[near[:, hit].argmax(axis=0)]])
                    b.append(fps[new])
                    left[new] = False
                    found.append(new)
            front = np.concatenate(found) if found else np.empty(0, int)
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links_of(key: np.ndarray, kind: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole runs of equal keys; two entries of kind 1 are never compared."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    length = np.diff(np.r_[start, len(key)])
    size = np.repeat(length, length)
    a, b = [], []
    for k in range(1, min(SHORT_RUN, int(length.max(initial=1)))):
        i = np.flatnonzero((key[:-k] == key[k:]) & (size[:-k] <= SHORT_RUN) & ((kind[:-k] == 0) | (kind[k:] == 0)))
        i = i[_close(fp[i], fp[i + k], most)]
        a.append(fp[i])
        b.append(fp[i + k])
    for s, n in zip(start[length > SHORT_RUN], length[length > SHORT_RUN], strict=True):
        own = kind[s : s + n] == 0
        x, y = _search(fp[s : s + n][own], fp[s : s + n][~own], most)
        a.append(x)
        b.append(y)
    none = np.empty(0, np.uint64)
    x, y = (np.concatenate(a), np.concatenate(b)) if a else (none, none)
    return x[x != y], y[x != y]


def _link_batches(most: int):
    def run(batches):
        kept = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            last = np.searchsorted(now[0], now[0][-1])  # the last run may go on in the next batch
            kept = [x[last:] for x in now]
            yield from emit(*(x[:last] for x in now))
        if kept is not None:
            yield from emit(*kept)

    def emit(key, kind, fp):
        a, b = _links_of(key, kind, fp.astype(np.int64).view(np.uint64), most)
        if len(a):
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def _up_batches(batches):
    """(cell, rows) of the cells one step up from each cell, which get all of its rows."""
    for batch in batches:
        cell, rows = (batch.column(i).to_numpy() for i in (0, 1))
        c, half = cell.astype(np.uint64) & _HALF, cell.astype(np.uint64) >> np.uint64(32)
        out, n = [], []
        for i in range(16):
            first, second = np.uint64(1 << (2 * i)), np.uint64(2 << (2 * i))
            can = (c & second) == 0
            out.append((np.where((c & first) == 0, c | first, c | second) | half << np.uint64(32))[can])
            n.append(rows[can])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.int64)), pa.array(np.concatenate(n))], ["cell", "rows"])


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ in 1 to ``max_distance`` (at most 3) bits.

    Every two fingerprints within the distance are linked directly or through others of their cell. A cell that gets
    more than about ``cell_rows`` is dealt to a square of tasks by a hash of the fingerprint: task (i, j) compares the
    own entries of part i with all entries of part j, so no task holds the cell and each pair is compared in two at most.
    """
    if max_distance > 3:
        raise ValueError("the two halves of the grid only cover distances up to 3")
    prepare(fps.sparkSession)
    # an explicit number of partitions: the few bytes here become 26 times as many
    distinct = fps.select("fp").distinct().repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    grid = distinct.mapInArrow(_cell_batches, "cell bigint, kind tinyint, fp bigint")
    full = grid.where("kind = 0").groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > cell_rows).checkpoint()
    hot = full.union(full.mapInArrow(_up_batches, "cell bigint, rows bigint")).groupBy("cell").agg(F.ceil(F.sum("rows") / cell_rows).cast("int").alias("parts"))
    hot = small(hot)
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    place = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).cast("tinyint").alias("kind"))
    as_own = F.when(F.col("kind") == 0, F.transform(every, lambda j: place(part, j, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,kind:tinyint>>"))
    as_other = F.transform(F.filter(every, lambda i: (F.col("kind") == 1) | (i != part)), lambda i: place(i, part, 1))
    places = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("kind")))).otherwise(F.concat(as_own, as_other))
    split = grid.join(hot, "cell", "left").select("cell", "fp", F.explode(places).alias("p")).select(F.xxhash64("cell", "p.i", "p.j").alias("key"), "p.kind", "fp")
    return split.repartition("key").sortWithinPartitions("key", "kind").mapInArrow(_link_batches(max_distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other. component_id is the smallest doc_id
    reachable (null ids are ignored for it; a component of null ids has none). Repeated rows give repeated results.
    An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    prepare(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col).checkpoint()
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).checkpoint()
    roots = components(links(first, max_distance))
    rooted = first.join(roots, first.fp == roots.node).select("root", "fp", "first_id")
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = rooted.join(lowest, "root").select("fp", "component_id")
    whole = first.join(small(moved), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest id.

    Rows that repeat an id are one document and share its fate. Rows with a null id are kept.
    """
    found = near_duplicates(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    gone = small(found.where(~F.col("first")).select(F.col("doc_id").alias("__gone")))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
