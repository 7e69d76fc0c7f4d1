import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import mixing, packing
from tests.conftest import same
from tests.llm import brute


def test_mix_equals_its_sql(spark, sf, duck):
    got = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
    same(got.toPandas(), duck.sql(mixing.SQL_MIX).df())


def mixed_docs(n=900):
    rng = np.random.default_rng(2)
    source = rng.choice(["é", "Z", "a", "b", None, ""], n, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05])
    return [(k, " ".join(["w"] * int(rng.integers(0, 60))) if k % 50 else None, source[k]) for k in range(n)]


def test_mix_targets_and_takes(spark):
    docs = mixed_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"h": F.lit(1), "size": F.lit(2), "source_key": F.lit(3)})
    rows = mixing.mix(df).collect()
    target, size = brute.mix([(i, s, len(brute.words(t))) for i, t, s in docs])
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(rows) == len(docs) and all(0 <= target[s] - taken[s] <= 60 for s in size)
    assert sorted(rows) == sorted(mixing.mix(df.repartition(9)).collect())
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in rows)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mixed(df).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (None, " ", None)], df.schema)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_mix_stays_without_python(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(rows, want, most=2048, padding=None):
    """Pieces cover each example once, in sequences without gaps; all but powers of two are full."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(by_doc) == set(want)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most and at & (at - 1) == 0  # no padding at all
    return by_seq


def test_packing_round_trip(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a\x01b <|endoftext|> É́ 'll x"), (10**6 + 3, "word " * 50_000)]
    df = df.union(spark.createDataFrame(odd, df.schema)).withColumn("start", F.lit("x")).repartition(3)
    t = encoder()
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.collect()}
    check_packing(packing.pack(df).collect(), want)
    rows = packing.pack(df.filter("doc_id = 1000002"), with_ids=True).orderBy("start").collect()
    assert [i for r in rows for i in r.ids] == want[1000002]


def test_packing_keeps_all_limits(spark):
    docs = [(k, "a b c " * (k % 40), k % 30) for k in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, loss long")
    rows = packing.pack(df, max_tokens=128, max_segments=3, max_loss=40, loss_col="loss").collect()
    sequences = check_packing(rows, {i: encoder().encode(t, add_special_tokens=False).ids + [1] for i, t, _ in docs}, 128)
    loss = {i: n for i, _, n in docs}
    for own in sequences.values():
        bearing = sum(max(0, r.start + r.length - max(r.start, r.doc_tokens - min(loss[r.doc_id], r.doc_tokens))) for r in own)
        assert len(own) <= 3 and bearing <= 40


def test_packing_of_repeated_ids_and_nothing(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert sum(r.length for r in packing.pack(df).collect()) == 6
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, max_tokens=100)


def test_loss_limit_binds_and_last_pieces_are_packed_together(spark):
    """Long examples bear more loss than a sequence may hold: prompts of others fill the rest. Few short sequences for all tasks."""
    rng = np.random.default_rng(3)
    docs = [(k, "a b c d " * int(rng.integers(1, 900))) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    rows = packing.pack(df, **packing.INSTRUCTIONS).collect()
    sequences = check_packing(rows, {i: encoder().encode(t, add_special_tokens=False).ids + [1] for i, t in docs})
    bearing = {k: sum(max(0, r.start + r.length - max(r.start, int(r.doc_tokens * 0.25))) for r in own) for k, own in sequences.items()}
    full = [k for k, own in sequences.items() if sum(r.length for r in own) == 2048]
    assert max(bearing.values()) <= 1792 and max(map(len, sequences.values())) <= 64
    assert sum(bearing[k] == 1792 for k in full) > 0.1 * len(full)
    assert len(sequences) - len(full) <= 16  # in one task's neighbourhood
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack(df, **packing.INSTRUCTIONS).collect()))


def test_packing_by_a_tokenizer_that_joins_over_white_space(spark, tmp_path):
    from tokenizers import Tokenizer, models

    path = str(tmp_path / "joins.json")
    Tokenizer(models.BPE({"a": 0, " ": 2, "b": 3, "a ": 4, "a b": 5}, [("a", " "), ("a ", "b")])).save(path)
    df = spark.createDataFrame([(1, "a b"), (2, "b a")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in packing.pack(df, tokenizer=path, with_ids=True).collect()}
    assert got == {1: [5, 1], 2: [3, 2, 0, 1]}
