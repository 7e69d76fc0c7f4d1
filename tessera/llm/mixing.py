"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Each source has a budget of words. The words of its documents are summed by hash bucket; the buckets that fit the
budget are taken, and only the bucket at the boundary is looked into, by the next digits of the hash. What remains is a
filter on the hash: nothing is sorted, and adding to a budget only ever adds documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, named, unused, written

#: The hash has LEVELS digits of BITS bits: a boundary bucket of the last level holds one in 2**48 documents.
BITS, LEVELS = 12, 4


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source_key, source_size, target from rows (source_key, source, size).

    A source's target is its weight times one common level, or `most` times its size if that is less: the level at
    which the targets make up `share` of all sizes. Sources are in order of code points, null last, and take the
    weights in turn.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.first("source", ignorenulls=True).alias("source"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row for each source only
    s = s.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int"))).withColumn("limit", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "source_key")
    all_rows = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "capped": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "budget": share * F.sum("source_size").over(all_rows),
    })
    # the level if just the sources before this one are at their limit; the first that isn't above its own limit holds
    s = s.withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    s = s.withColumn("common", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("limit") / F.col("weight"))).over(all_rows))
    return s.select("source_key", "source_size", F.least("limit", F.coalesce(F.col("common") * F.col("weight"), F.col("limit"))).alias("target"))


def _hash(id_col: str) -> Column:
    digits = F.substring(F.md5(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), named(source_col)), F.lit("n"))


def thresholds(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source_key, source_size, target, whole, low for rows (source_key, source, size, h): a source's documents are taken
    `whole` times, and those with a hash under `low` once more."""
    goal = source_targets(sized, weights, share, most)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumns({"rest": F.col("target") - F.col("whole") * F.col("source_size"), "low": F.lit(0).cast("long")})
    for level in range(LEVELS):  # low: hashes under it are taken; rest: words still to take from the bucket that begins there
        width = 1 << (BITS * (LEVELS - 1 - level))
        inside = sized if level == 0 else sized.join(goal.select("source_key", "low"), "source_key").filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width * (1 << BITS)))
        bars = inside.groupBy("source_key", F.floor(F.col("h") / width).cast("long").alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket"))  # 4096 rows a source at most
        bars = bars.withColumn("upto", upto).join(goal.select("source_key", "rest"), "source_key")
        fits = F.col("upto") <= F.col("rest")
        edge = bars.groupBy("source_key").agg(F.min(F.when(~fits, F.col("bucket"))).alias("bucket"), F.max(F.when(fits, F.col("upto"))).alias("took"))
        goal = goal.join(edge, "source_key", "left").select(
            "source_key", "source_size", "target", "whole",
            (F.col("rest") - F.coalesce("took", F.lit(0))).alias("rest"),
            F.coalesce(F.col("bucket") * width, F.col("low") + width * (1 << BITS)).alias("low"),
        )
        goal = written(goal, "goal")  # a row for each source
    return goal.drop("rest")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(named(id_col).alias("doc_id"), named(source_col).alias("source"), n_words(named(text_col)).alias("size"), _hash(id_col).alias("h"), _key(source_col).alias("source_key")), "sized")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken.

    Every document of a source is taken floor(target / source_size) times, and those whose hash is under the source's
    threshold once more, so that a source takes its target at most, and less than it by no more than the document at the
    boundary. The hash is md5 of the id: reruns agree. A null or blank text has size 0 and takes nothing; a null source is a
    source of its own, after the others; a null id hashes as the empty text; rows that repeat an id are taken alike. An
    empty table gives an empty result; other columns are not read. most is a whole number, else a ValueError.
    """
    _whole(most)
    sized = _sized(docs, id_col, text_col, source_col)
    out = sized.join(thresholds(sized, weights, share, most), "source_key")
    copies = F.least(F.col("whole") + (F.col("h") < F.col("low")).cast("long"), F.lit(int(most)))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def _whole(most: float) -> None:
    if most != int(most) or most < 1:
        raise ValueError("most is a whole number of times, 1 at least: a document is taken whole or not at all")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, each as often as mix() takes it. Columns may have any names."""
    _whole(most)
    goal = thresholds(_sized(docs, id_col, text_col, source_col), weights, share, most)
    own = {c: unused(docs.columns, f"_mix_{c}") for c in ("source_key", "whole", "low", "copy")}
    goal = goal.select(*[F.col(c).alias(own[c]) for c in ("source_key", "whole", "low")])
    out = docs.join(goal, _key(source_col) == F.col(own["source_key"]))
    copies = F.least(F.col(own["whole"]) + (_hash(id_col) < F.col(own["low"])).cast("long"), F.lit(int(most)))
    return out.withColumn(own["copy"], F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*map(named, docs.columns))


SQL_MIX = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
lim AS (SELECT *, 2.0::DOUBLE * source_size AS lim FROM src),
lev AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM lim WINDOW before AS (ORDER BY lim / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size::BIGINT AS source_size,
         least(lim, coalesce(weight * (SELECT arg_min(level, lim / weight) FROM lev WHERE level * weight <= lim), lim)) AS target
  FROM lev),
part AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         sum(size) OVER (PARTITION BY sized.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target,
       size * least(whole + CASE WHEN upto <= target - whole * source_size THEN 1 ELSE 0 END, 2)::BIGINT AS taken
FROM part
"""
