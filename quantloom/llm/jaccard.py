"""Near-duplicates by the Jaccard similarity of five-word shingles, for the pipeline's near_dedup stage.

The fingerprints of five-word shingles and their grid (simhash.py) propose pairs, but at similarity 0.8 fingerprints differ in
about ten bits of 64, far beyond what the grid reaches. So bands of MinHash values propose the others: a pair of
similarity s shares none of the 32 bands of 5 minima with probability (1 - s^5)^32, 3e-6 at 0.8. What is proposed is
decided on the whole shingle sets: proposals are connected first, and the members of each connected group meet in one
task, as their differences from what most of the group has in common. Texts of equal sets are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import simhash
from quantloom.llm.base import forget, prepare, small
from quantloom.llm.graph import components

SHINGLE = 5
SEED = 42
BANDS = 32
BAND_ROWS = 5
#: The least similarity as a fraction, compared in whole numbers.
SIMILAR = (4, 5)
#: Bytes of the shingle sets that one task holds of a group; larger groups are dealt to several tasks.
GROUP_BYTES = 24 << 20
_CHUNK = 1 << 12
_RANDOM = np.random.default_rng(SEED)
_ODD = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's shingles; a text of fewer words is one shingle, of none none."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def node_of(hashes: np.ndarray) -> int:
    """One signed long for each distinct set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The bands' keys as signed longs; an empty set has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        mixed = hashes[at : at + _CHUNK, None] * _ODD + _PLUS
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64)


def _band_batches(batches):
    forget()
    for batch in batches:
        out = []
        for t in batch.column(1).cast(pa.binary()):
            hashes = simhash.shingle_hashes(t.as_py(), SHINGLE)
            kept = np.unique(hashes)
            out.append((node_of(kept), len(kept), simhash.bits_of(hashes), bands(kept)))
        fps = np.fromiter((x[2] for x in out), np.uint64, len(out)).view(np.int64)
        columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(fps), pa.array([x[3] for x in out], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "node", "size", "fp", "bands"])


def _set_batches(batches):
    """The texts' sets, of the rows that have the node asked for (ids may repeat with other texts)."""
    forget()
    for batch in batches:
        asked, keep, blobs = batch.column(1).to_pylist(), [], []
        for i, t in enumerate(batch.column(0).cast(pa.binary())):
            found = shingles(t.as_py())
            if node_of(found) == asked[i]:
                keep.append(i)
                blobs.append(found.tobytes())
        rest = batch.select([1, 2, 3]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(blobs, pa.binary())], ["node", "root", "parts", "hashes"])


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (numbers of different sets) that span what all pairs of the least similarity connect.

    Two sets are similar enough if their symmetric difference is small against their sizes, and that is the one of
    their differences from any third set. Of that from the elements most sets have, few are left to count.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    n, more, less = len(sets), SIMILAR[0] + SIMILAR[1], SIMILAR[1] - SIMILAR[0]
    element, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    common = np.bincount(column, minlength=len(element)) * 2 > n
    usual = np.flatnonzero(common)
    has = np.zeros((n, len(usual)), bool)
    has[row[common[column]], np.searchsorted(usual, column[common[column]])] = True
    lacks, which = np.nonzero(~has)
    row, column = np.r_[row[~common[column]], lacks], np.r_[column[~common[column]], usual[which]]
    differs = np.bincount(row, minlength=n)
    by_row, by_column = np.argsort(row, kind="stable"), np.argsort(column, kind="stable")
    columns_of, rows_of = column[by_row], row[by_column]
    row_start, column_start = np.r_[0, np.cumsum(differs)], np.r_[0, np.cumsum(np.bincount(column, minlength=len(element)))]
    left, out = np.ones(n, bool), []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            x = front.pop()
            own = columns_of[row_start[x] : row_start[x + 1]]
            shared = np.concatenate([rows_of[column_start[c] : column_start[c + 1]] for c in own.tolist()]) if len(own) else own
            between = differs[x] + differs - 2 * np.bincount(shared, minlength=n)
            new = np.flatnonzero(left & (more * between <= less * (size[x] + size))).tolist()
            left[new] = False
            front += new
            out += [(x, y) for y in new]
    return out


def _group_batches(batches):
    """Links within each run of rows (key, node, hashes) of one key; runs may go over several batches."""
    forget()
    key, nodes, sets = None, [], []

    def links():
        if len(nodes) < 2:
            return []
        different, at = np.unique(np.array(nodes, np.int64), return_index=True)
        if len(different) < 2:
            return []
        return [(int(different[i]), int(different[j])) for i, j in spanning_links([np.frombuffer(sets[k], np.uint64) for k in at.tolist()])]

    for batch in batches:
        found = []
        for k, node, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                found += links()
                key, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(hashes)
        yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})
    found = links()
    yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def proposals(first: DataFrame) -> DataFrame:
    """(a, b) between nodes that share a band or a fingerprint or whose fingerprints are linked: one row for each member of
    a band or fingerprint, to its smallest node. ``first`` has (node, fp, bands)."""

    def stars(rows: DataFrame) -> DataFrame:
        shared = rows.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").select("key", "b")
        return rows.join(shared, "key").select(F.col("node").alias("a"), "b").where("a <> b")

    by_fp = first.select(F.col("fp").alias("key"), "node")
    close = simhash.links(first.select("fp"))
    lowest = by_fp.groupBy("key").agg(F.min("node").alias("node"))
    close = close.join(lowest.withColumnRenamed("node", "x"), F.col("a") == F.col("key")).select("x", "b")
    close = close.join(lowest.withColumnRenamed("node", "y"), F.col("b") == F.col("key")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return stars(first.select(F.explode("bands").alias("key"), "node")).union(stars(by_fp)).union(close).distinct()


def links(first: DataFrame, docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Links (a, b) between nodes that span the components of all proposed pairs of the least similarity.

    ``first`` has (node, size, fp, bands, doc_id) and ``docs`` (doc_id, text). A group of more than ``group_bytes`` is dealt
    by a hash of the node into parts, and each two parts meet in a task.
    """
    groups = components(proposals(first)).checkpoint()
    members = groups.join(first.select("node", "size", "doc_id"), "node")
    total = members.groupBy("root").agg((F.sum("size") * 8).alias("bytes"))
    parts = total.select("root", F.when(F.col("bytes") > group_bytes, F.ceil(F.col("bytes") * 2 / group_bytes)).otherwise(1).cast("int").alias("parts"))
    asked = small(members.join(parts, "root").select(F.col("doc_id").alias("__id"), "node", "root", "parts"))
    sets = docs.join(asked, docs["doc_id"] == asked["__id"]).select("text", "node", "root", "parts").mapInArrow(_set_batches, "node bigint, root bigint, parts int, hashes binary")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (F.col("parts") == 1) | (j != part))
    keyed = sets.select("root", "node", "hashes", part.alias("i"), F.explode(others).alias("j"))
    keyed = keyed.select(F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "node", "hashes")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_group_batches, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for each row: the smallest id reachable by pairs of similarity 0.8 or more.

    Words are lower-cased in ASCII and parted by ASCII space. Texts without a word are alike. Null ids are ignored for
    component_id; a component of null ids has none. Repeated rows give repeated results. An empty table gives an empty
    result; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    rows = slim.mapInArrow(_band_batches, f"doc_id {kind}, node bigint, size bigint, fp bigint, bands array<bigint>").checkpoint()
    first = rows.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands")).checkpoint()
    roots = components(links(first, slim))
    rooted = first.select("node", F.col("doc_id").alias("first_id")).join(roots, "node").select("root", "node", "first_id")
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = rooted.join(lowest, "root").select("node", F.col("component_id").alias("moved"))
    whole = first.select("node", "doc_id").join(small(moved), "node", "left").select("node", F.coalesce("moved", "doc_id").alias("component_id"))
    return rows.select("doc_id", "node").join(whole, "node", "left").select("doc_id", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest id.

    Rows that repeat an id are one document and share its fate. Rows with a null id are kept.
    """
    found = near_duplicates(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    gone = small(found.where(~F.col("first")).select(F.col("doc_id").alias("__gone")))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
