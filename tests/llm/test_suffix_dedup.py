"""Repeated strings against a plain version, suffix orders, and edge cases."""

import hashlib
import random
from collections import Counter

import pytest

from tessera.llm import queries, suffix_dedup


def plain(texts, length):
    """(spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    often = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if often[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        edges = [k for k in range(len(d) + 1) if (gone[k - 1] if k else 0) != (gone[k] if k < len(d) else 0)]
        out.append(([(a, b - a) for a, b in zip(edges[::2], edges[1::2], strict=True)], bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    return out


def letters(rng, n, of="abcdefgh "):
    return "".join(rng.choice(of) for _ in range(n))


def corpus(seed):
    """Copies, near copies, passages at different places, periodic texts, texts around the limit."""
    rng = random.Random(seed)
    passages = [letters(rng, n) for n in (39, 40, 41, 90, 400)]
    texts = [letters(rng, rng.randint(0, 60)) + rng.choice(passages) + letters(rng, rng.randint(0, 60)) for _ in range(60)]
    texts += [texts[0]] * 3 + [t[:50] + "#" + t[51:] for t in texts[:20]]
    texts += ["a" * n for n in (39, 40, 41, 300)] + ["ab" * 100, "xyz" * 70, "q" + "xyz" * 60, passages[4] + passages[4][7:], "é" * 45, None, "", " "]
    return texts


@pytest.mark.parametrize("seed", range(8))
def test_suffixes_are_in_order(seed):
    rng = random.Random(seed)
    for n in (1, 2, 3, 50, 700):
        data = letters(rng, n, "ab" if seed % 2 else "abc\0\xff").encode("latin-1") * (1 + seed % 3)
        got = suffix_dedup.suffix_order(data, len(data)).tolist()
        assert got == sorted(range(len(data)), key=lambda k: data[k:])


def rows(found, name="doc_id"):
    return {r[name]: ([tuple(x) for x in r["spans"]], bytes(r["kept"])) for r in found.collect()}


@pytest.mark.parametrize("hot", [1 << 20, 150])
def test_result_equals_the_plain_one(spark, monkeypatch, hot):
    """Also where pieces of a key are too many for one task, and where pieces and sorted portions are small."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = corpus(hot)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = rows(suffix_dedup.remove_repeats(docs, length=40, gram=12))
    assert got == dict(enumerate(plain(texts, 40)))


def test_query_equals_the_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    own = {}
    for (doc_id, text), (spans, kept) in zip(docs, plain([t for _, t in docs], 400), strict=True):
        n = len((text or "").encode())
        own[doc_id] = (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in queries.op12_suffix_dedup(spark, sf).collect()}
    assert got == own and any(x[1] for x in own.values())


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    rng = random.Random(3)
    a, b = letters(rng, 500), letters(rng, 500)
    docs = spark.createDataFrame([(1, a, 1), (1, a, 2), (None, b, 3), (None, None, 4), (2, letters(rng, 450), 5)], "`a.b` int, text string, kept int")
    got = sorted(((r["a.b"], r["n_bytes"], len(r["kept"])) for r in suffix_dedup.remove_repeats(docs, "a.b").collect()), key=str)
    assert got == sorted([(1, 500, 0), (1, 500, 0), (None, 500, 500), (None, 0, 0), (2, 450, 450)], key=str)
    assert suffix_dedup.remove_repeats(docs.limit(0), "a.b").count() == 0
    with pytest.raises(ValueError, match="gram"):
        suffix_dedup.remove_repeats(docs, "a.b", length=4, gram=3)


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    rng = random.Random(4)
    shared = letters(rng, 700)
    texts = [letters(rng, 1500) + shared + letters(rng, 900), letters(rng, 300) + shared, "z" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def with_small_chunks(batches):
        suffix_dedup.CHUNK = 256
        yield from suffix_dedup._pieces(batches, length=40, gram=12)

    keyed = docs.selectExpr("doc_id AS k1", "doc_id AS k2", "CAST(text AS binary) AS text")
    cut = keyed.mapInArrow(with_small_chunks, "k1 long, k2 long, key long, start long, n int, twice boolean, digest binary").collect()
    for k, t in enumerate(texts):
        starts = sorted(s for r in cut if r["k1"] == k for s in range(r["start"], r["start"] + r["n"]))
        assert starts == list(range(len(t) - 39))
    assert rows(suffix_dedup.remove_repeats(docs, length=40, gram=12)) == dict(enumerate(plain(texts, 40)))
