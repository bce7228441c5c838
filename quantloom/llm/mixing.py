"""Mixing sources to target weights, in DataFrame functions only.

Tokens are aggregated per source; each source's share of the budget is its weight's share, but no more than a fixed
multiple of what it has, the excess going to the others by weight. The shares solve a water-filling problem: every
target is least(cap, weight * level) for one level, which running sums over the sources ordered by cap / weight give.
A document is then taken floor(rate) times, and once more with a probability of the rate's fraction, decided by a
hash of its id and a seed, so reruns agree and a lost task gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quantloom.llm.base import WORD, prepare, small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix"


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) of the id: the first 52 bits of an MD5. Null ids count as the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) of each source, from (source, size) rows.

    Sources are ordered by code point, null last, and the weights repeat in that order. One row for each source meets
    in one task here, after aggregation.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = by_source.select("source", "source_size", cycle.cast("bigint").alias("weight")).withColumn("cap", F.col("source_size") * most)
    rising = W.Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.Window.unboundedPreceding, -1)
    all_of = W.Window.partitionBy()
    level = (F.sum("source_size").over(all_of) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levelled = weighed.withColumn("level", level)
    # The first source whose cap is not reached at the level of its turn fixes the level for it and all after it.
    fixed = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(all_of)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * fixed, F.col("cap").cast("double")))
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``docs``.

    size: words of the text, 0 for null or empty. A source without words has target 0 and is not taken. Rows that
    repeat an id are taken equally often. The join with the sources is a broadcast if the counted sources are few, and
    else a shuffle join, whose hot sources the engine splits. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    goal = small(targets(sized.select("source", "size"), weights, share, most), 200)
    return _copies(sized, goal, F.col("doc_id"), "source", seed)


def _copies(rows: DataFrame, goal: DataFrame, id_col: Column, source_col: str, seed: str) -> DataFrame:
    goal = goal.select(F.col("source").alias("__source"), F.col("source_size"), F.col("target"))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    extra = uniform(id_col, seed) < rate - F.floor(rate)
    return rows.join(goal, rows[source_col].eqNullSafe(goal["__source"])).withColumn("copies", (F.floor(rate) + F.when(extra, 1).otherwise(0)).cast("int")).drop("__source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as it is taken, and the columns of ``docs``."""
    prepare(docs.sparkSession)
    sized = docs.select(F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    goal = small(targets(sized).select("source", "source_size", "target"), 200)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("__id"), docs[source_col].cast("string").alias("__own"))
    took = _copies(own, goal, F.col("__id"), "__own", seed).where("copies > 0")
    return took.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
