import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, exact_dedup, minhash, union_find
from tests.conftest import same
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS)


def test_exact_groups_equal_their_sql(spark, sf, duck):
    same(exact_dedup.exact_groups(spark.read.parquet(f"{sf}/documents.parquet")).toPandas(), duck.sql(exact_dedup.SQL_GROUPS).df())


def test_exact_groups_of_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "Aa"), (4, "aA"), (5, "É"), (6, "é"), (7, "x" * 200_000), (8, "X" * 200_000), (9, "x" * 199_999)] + [(k, "same") for k in range(100, 700)]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, docs).repartition(7)).collect()}
    assert {i: got[i].keep_id for i in range(1, 10)} == {1: 2, 2: 2, 3: 4, 4: 4, 5: 5, 6: 6, 7: 8, 8: 8, 9: 9}
    assert all(got[k].keep_id == 699 and got[k].group_size == 600 for k in range(100, 700)) and sum(r.kept for r in got.values()) == 7
    assert got[2].text_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_exact_dedup_without_ids_empty_and_clashing_columns(spark):
    df = frame(spark, [(None, "a"), (5, "A"), (None, "b")]).withColumn("norm", F.lit(1)).withColumn("keep_id", F.lit(2)).withColumn("_kept", F.lit(3))
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "b"), (5, "A")]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_exact_groups_equal_brute_force_over_many_tasks(spark):
    """Groups that go on over several tasks, null and repeated ids, texts with a common beginning."""
    rng = random.Random(7)
    pool = [None, "", *("p" * 60 + str(k) for k in range(5)), *(f"Text {k}" for k in range(40))]
    docs = [(rng.choice([None, *range(300)]), rng.choice(pool) if rng.random() < 0.1 else rng.choice(["HOT", "hot"])) for _ in range(9000)]
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        rows = exact_dedup.exact_groups(frame(spark, docs).repartition(5)).collect()
        kept = exact_dedup.exact_dedup(frame(spark, docs).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    group = {}
    for i, t in docs:
        group.setdefault((t or "").lower(), []).append(-1 if i is None else i)
    want = sorted((-1 if i is None else i, max(own := group[(t or "").lower()]), len(own), hashlib.sha256((t or "").lower().encode()).hexdigest()) for i, t in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert sorted(((r.text or "").lower(), -1 if r.doc_id is None else r.doc_id) for r in kept) == sorted((t, max(own)) for t, own in group.items())


def test_exact_dedup_keeps_one_row_of_each_group(spark):
    docs = [(None, "a"), (5, "A"), (None, "b"), (1, "c"), (1, "C"), (1, "d"), (None, "e"), (None, "e"), (7, None), (7, "")]
    kept = exact_dedup.exact_dedup(frame(spark, docs).repartition(3))
    rows = [(r.doc_id, (r.text or "").lower()) for r in kept.collect()]
    assert sorted(rows, key=str) == sorted([(5, "a"), (None, "b"), (1, "c"), (1, "d"), (None, "e"), (7, "")], key=str)


def copies(rng, n, length=60):
    """Texts with near copies: edits of a few words, chains of edits, shared passages and short texts."""
    pool = [f"w{k}" for k in range(500)]
    docs, passage = {}, " ".join(rng.choices(pool, k=40))
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.5:
            w = docs[rng.choice(list(docs))].split() or ["x"]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(pool)
            docs[i] = " ".join(w)
        elif kind < 0.6:
            docs[i] = " ".join(rng.choices(pool, k=rng.randint(0, 5)))
        else:
            docs[i] = " ".join(rng.choices(pool, k=length)) + (" " + passage if kind > 0.9 else "")
    return docs


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups_equal_brute_force(spark, size):
    docs = copies(random.Random(size), 400)
    docs |= {1000: None, 1001: "", 1002: "  ", 1003: "One", 1004: "one", 1005: "a b", 1006: "A\tB", 1007: "long " * 30_000}
    got = {r.doc_id: r for r in minhash.near_groups(frame(spark, docs.items()), size=size).collect()}
    want = brute.near(docs, size)
    assert {i: got[i].component_id for i in docs} == want
    assert all(got[i].n_shingles == len(brute.shingles(t, size)) and got[i].kept == (want[i] == i) for i, t in docs.items())
    assert got[1000].kept and got[1003].component_id == got[1004].component_id == 1003


def test_near_groups_of_real_documents_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.component_id for r in minhash.near_groups(docs, size=4).collect()} == brute.near(texts, 4)


def test_near_dedup_of_repeated_ids_and_empty_tables(spark):
    df = frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f g h i j k l m n o p"), (None, None)]).withColumn("cid", F.lit(0)).withColumn("u", F.lit(0))
    out = minhash.near_dedup(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (1, "a b c d e f"), (2, "a b c d e f g h i j k l m n o p")]
    assert minhash.near_dedup(df.limit(0)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8):
        n = 400
        both, own = rng.integers(0, 2**63, int(n * share), dtype=np.uint64), [rng.integers(0, 2**63, n - int(n * share), dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([both, o])) for o in own]
        flat, owner = np.concatenate(sets), np.repeat([0, 1], [len(s) for s in sets])
        a, b = minhash.superminhash(flat, owner, 2, 1024)
        true = len(both) / (2 * n - len(both))
        assert abs((a == b).mean() - true) < 0.05
    a = minhash.superminhash(np.array([5], np.uint64), np.array([0]), 1, 96)
    assert (np.sort(a[0] >> 32) == np.arange(96)).all()  # one element takes every place once


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1400)] + [(k, k + 7) for k in range(2000, 2100)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)]
    got = {r.node: r.component for r in union_find.components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    want = brute.components({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n != c}
    assert union_find.components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors(rng, n, d=64):
    base = rng.normal(size=(12, d))
    rows = []
    for i in range(n):
        x = base[rng.integers(12)] + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.12, 1.0]) if rng.random() < 0.7 else rng.normal(size=d)
        rows.append((i, [float(np.float32(v)) for v in x], int(rng.integers(2))))
    return rows


def links_of(rows, threshold=0.98):
    good = [(i, np.array(e, float), lab) for i, e, lab in rows if e is not None and lab is not None and all(v is not None and np.isfinite(v) for v in e) and any(e)]
    out = []
    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[:k]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                out.append((j, i))
    return out


@pytest.mark.parametrize("width", [None, 4, 8, 12, 16])
def test_near_vectors_against_brute_force(spark, width):
    """At each width the tables find 99 in 100 of the links at least, pairs at just the threshold among them, and none too many."""
    rng = np.random.default_rng(width)
    rows = vectors(rng, 400)
    for k in range(100):
        x = np.array(rows[k][1]) / np.linalg.norm(rows[k][1])
        aside = rng.normal(size=64)
        aside -= (aside @ x) * x
        rows.append((600 + k, [float(np.float32(v)) for v in 0.9805 * x + np.sqrt(1 - 0.9805**2) * aside / np.linalg.norm(aside)], rows[k][2]))
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [float("inf")] + [1.0] * 63, 1), (904, [None] + [1.0] * 63, 1), (905, rows[0][1], None), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("unit", F.lit(1)).withColumn("k", F.lit(1))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, width=width).collect()}
    want = links_of(rows + odd)
    found = sum(r.n_links for r in got.values())
    assert len(got) == 509 and 0.99 * 2 * len(want) <= found <= 2 * len(want)
    comp, whole = {i: r.component_id for i, r in got.items()}, brute.components(got, want)
    assert comp == whole if found == 2 * len(want) else all(whole[c] == whole[i] for i, c in comp.items())
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905, 908))
    assert got[907].component_id == 906


def test_near_vectors_in_the_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sum(r.n_links for r in embedding_dedup.near_vectors(df).collect()) == 2 * len(links_of(rows))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_equal_vectors_are_one_class_and_repeated_ids_vectors_of_their_own(spark):
    x, y = [1.0] + [0.0] * 63, [0.0] * 63 + [1.0]
    df = spark.range(30_000).select(F.col("id").alias("vec_id"), F.array(*map(F.lit, x)).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    more = spark.createDataFrame([(7, y, 1), (40_000, y, 1), (40_001, y, 2), (None, y, 2)], "vec_id long, embedding array<float>, label int")
    rows = embedding_dedup.near_vectors(df.union(more)).filter("vec_id IS NULL OR vec_id = 7 OR vec_id >= 29999").collect()
    assert sorted((r.vec_id or -1, r.n_links, -1 if r.component_id is None else r.component_id) for r in rows) == [(-1, 0, -1), (7, 1, 7), (7, 29_999, 0), (29_999, 29_999, 0), (40_000, 1, 7), (40_001, 0, 40_001)]


def test_tables_grow_with_a_part_and_miss_few(spark):
    """One rule at every size: of vectors turned by the threshold's angle, also off a common part, few are in no table."""
    rng = np.random.default_rng(8)
    x = embedding_dedup.unit(rng.normal(size=(3000, 64)) + 2 * rng.normal(size=64))
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    turned = 0.98 * x + np.sqrt(1 - 0.98**2) * aside / np.sqrt((aside**2).sum(1, keepdims=True))
    before = 0
    for width in (1, 6, 12, 20):
        made = embedding_dedup.index(x[:1500], 0.98, width)
        missed = ~(made.parts(x[1500:]) == made.parts(turned[1500:])).any(1)
        assert made.tables >= before and missed.mean() <= 0.01
        before = made.tables


def test_rotations_codes_and_tables_are_used_at_the_smallest_size(spark, sf, monkeypatch):
    """Parts of four bits at least, learnt rotations, a Hamming radius under that of all pairs, and few groups to compare."""
    made = []
    monkeypatch.setattr(embedding_dedup, "index", lambda *a, f=embedding_dedup.index: made.append(f(*a)) or made[-1])
    embedding_dedup.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")).count()
    assert made[0].width >= 4 and made[0].rotations and made[0].tables > 1 and made[0].near < 24


def test_codes_tell_vectors_apart_and_keep_turned_ones():
    """Misses are counted on vectors that nothing was learnt from: those of the index and fresh ones agree."""
    rng = np.random.default_rng(6)
    x = embedding_dedup.unit(rng.normal(size=(4000, 64)))
    made = embedding_dedup.index(x[:2000], 0.98, 6)
    other = embedding_dedup.turned(x[2000:], 0.98, rng)
    apart = np.bitwise_count(made.codes(x[2000:]) ^ made.codes(other))
    in_none = ~(made.parts(x[2000:]) == made.parts(other)).any(1)
    assert (apart > made.near).mean() <= 0.003 and in_none.mean() <= 0.003
    assert (np.bitwise_count(made.codes(x[:1000]) ^ made.codes(x[1000:2000])) <= made.near).mean() < 0.001


def test_large_buckets_and_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CODES", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    rng = np.random.default_rng(9)
    base = rng.normal(size=64)
    rows = [(k, [float(np.float32(v)) for v in base + 0.1 * rng.normal(size=64)], 1) for k in range(150)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sum(r.n_links for r in got) == 2 * len(links_of(rows)) > 0
