from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import exact_dedup, minhash, mixing, queries, toxicity
from tessera.llm.common import remainder
from tests.llm import brute


def test_names_and_sql():
    names = entry.queries()
    assert {n for n in names if n.startswith("op")} == set(queries.queries()) and len(queries.queries()) == 13 and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash", "mixing", "packing"]


def test_run_equals_its_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels, held_out=remainder(F.col("doc_id"), 3) == 1).collect() if r.predicted}
    kept = {}
    for i in sorted(set(texts) - toxic, reverse=True):
        kept.setdefault(" ".join(map(bytes.decode, [(texts[i][0] or "").encode().lower()])), i)
    left = set(kept.values())
    comp = brute.near({i: texts[i][0] for i in left}, 5)
    left = {i for i in left if comp[i] == i}
    copies = {r.doc_id: r.copies for r in mixing.mix(docs.filter(F.col("doc_id").isin(list(left)))).collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    starts = {}
    for r in rows:
        if r.start == 0:
            starts[r.doc_id] = starts.get(r.doc_id, 0) + 1
    assert starts == {i: n for i, n in copies.items() if n}
    assert exact_dedup.exact_dedup(docs).columns == minhash.near_dedup(docs).columns == docs.columns


def test_stages_of_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, further columns, and nothing at all."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two three four five six", "en", "a", 9), (3, "One two three four five six", None, None, 9), (3, "One two three four five six", None, None, 9), (4, long, "en", "b", 1), (5, long + " more", "en", "b", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, kinds).withColumns({"row": F.lit(1), "_row": F.lit(2), "norm": F.lit(3), "task": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs = docs.cache()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5:] == ["row", "_row", "norm", "task"], name
        if name == "exact_dedup":  # the empty text with the largest id, and the short one
            assert sorted((r.doc_id, r.text[:3] if r.text else "") for r in docs.collect()) == [(2, ""), (3, "One"), (4, "w0 "), (5, "w0 ")]
        if name == "minhash":
            assert sorted(r.doc_id for r in docs.collect()) == [2, 3, 4]
    packed = corpus_pipeline.pack_sequences(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


def test_columns_of_any_name_keep_their_values(spark, tmp_path, sf):
    """Through run's stages: dots, quotes and names that operators use themselves."""
    odd = {"a.b": 3, "_mix_copy": 7, "_mix_low": 8, "_mix_whole": 9, "_mix_source_key": 10, "_row": 11, "norm": 12, "q`t": 13, "copies": 14, "row": 15}
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    for c, v in odd.items():
        docs = docs.withColumn(c, F.lit(v) + F.col("doc_id"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names, name
        rows = docs.collect()
        assert rows and all(r[names.index(c)] == v + r["doc_id"] for r in rows for c, v in odd.items()), name
    assert corpus_pipeline.pack_sequences(spark, docs, sf).count() > 0


def test_a_fraction_of_times_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    for most in (1.5, 0):
        for f in (mixing.mix, mixing.mixed):
            try:
                f(docs, most=most)
            except ValueError:
                continue
            raise AssertionError(most)


def test_workspaces_of_threads_are_their_own(spark):
    """What another thread writes while a workspace is open here stays when it is closed."""
    import threading

    from tessera.llm.common import workspace, written

    made = []
    with workspace(spark):
        other = threading.Thread(target=lambda: made.append(written(spark.range(5).toDF("x"), "t")))
        other.start()
        other.join()
    assert made[0].count() == 5
