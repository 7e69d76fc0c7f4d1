"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, exact_dedup, language_id, language_model, licenses, minhash, mixing, packing, periodic, prefix_trie, quality, suffix_dedup, toxicity
from tessera.llm.common import remainder, table, written


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 3) == 1
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=held_out)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), size=4)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), held_out=remainder(F.col("doc_id"), 5) == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first quarter of a document stands for its prompt
    return packing.pack(table(spark, sf_dir, "documents"), **packing.INSTRUCTIONS)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), held_out=remainder(F.col("doc_id"), 7) == 2)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 5) == 0
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=held_out)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of a tenth of the documents, by crc32 of the id, go on periodically from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("words", F.when(F.col("chosen"), F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("IF(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> words[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    return rows.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    milli = F.floor(1000 * length / period).cast("long")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digested turns of the conversations, each with up to three first turns of one of twenty, by crc32 of the id; all ids."""
    turns = prefix_trie.digested(conversations)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest"))
    turns = written(turns.withColumn("turn", place), "placed")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    ids = turns.filter("turn = 1").select("conv_id")
    heads = turns.filter("turn <= 3 AND conv_id % 20 = 0").withColumnRenamed("conv_id", "head")
    given = ids.withColumn("head", F.expr("conv_id - conv_id % 20")).join(heads, "head").filter(F.col("turn") <= h)
    return turns.filter(F.col("turn") > h).unionByName(given.drop("head")), ids


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie.trie(*rebuilt(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 of a number's decimal text, bit by bit, modulo 4.
_CRC4 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda z, i: xor(z >> 1, CASE WHEN z & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4"""
SQL_TRIE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS k FROM d),
i AS (SELECT conv_id, {_CRC4.format("conv_id")} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT t.conv_id, k, digest, words FROM t JOIN i USING (conv_id) WHERE k > h
  UNION ALL SELECT i.conv_id, k, digest, words FROM i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 20 WHERE k <= h),
p AS (SELECT conv_id, row_number() OVER w AS depth, words, string_agg(digest, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM i),
n AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS cost FROM p GROUP BY path),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, left(path, greatest(0, length(path) - 64)) AS up FROM n LEFT JOIN k USING (path)),
s AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.cost)::BIGINT AS saved_tokens FROM m a JOIN m b ON starts_with(b.path, a.path) GROUP BY 1),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT m.conv_id, m.depth::BIGINT AS depth, CASE WHEN m.depth > 0 THEN u.conv_id END AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN s USING (path) LEFT JOIN n u ON u.path = m.up LEFT JOIN e ON e.path = m.path
"""


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact_dedup.SQL_GROUPS, "op9_mixing": mixing.SQL_MIX, "op13_prefix_trie": SQL_TRIE}
