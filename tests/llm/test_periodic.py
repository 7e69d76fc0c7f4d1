"""Periodic runs against a plain version, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import periodic, queries


def plain_runs(w, least=6, times=4):
    """By every period: stretches where words p apart agree; the smallest period of equal stretches."""
    found = {}
    for p in range(1, len(w) // times + 1):
        k = 0
        while k < len(w) - p:
            if w[k] != w[k + p]:
                k += 1
                continue
            a = k
            while k < len(w) - p and w[k] == w[k + p]:
                k += 1
            if k + p - a >= max(least, times * p):
                found.setdefault((a, k + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    rest = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def made(seed, n):
    """Words of small alphabets with periodic stretches, some of which touch or overlap."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        out += unit * rng.randint(1, 9) + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]
    return out[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_the_plain_ones(seed):
    docs = [made(seed * 100 + k, 3 + 11 * k) for k in range(30)] + [["a"] * 300, ["a", "b"] * 90, [], ["x"]]
    numbers = {c: k for k, c in enumerate("abcdefghx")}
    ids, sizes = np.array([numbers[x] for d in docs for x in d], np.int32), np.array([len(d) for d in docs])
    found = periodic._found(ids, sizes, 6, 4).tolist()
    assert found == [[k, *r] for k, d in enumerate(docs) for r in plain_runs(d)]


def test_thue_morse_and_fibonacci_words():
    thue, fibonacci = [0], [[0], [0, 1]]
    for _ in range(11):
        thue += [1 - x for x in thue]
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    docs = [thue, fibonacci[11], thue[:700] * 5]
    found = periodic._found(np.concatenate(docs).astype(np.int32), np.array([len(d) for d in docs]), 6, 4).tolist()
    assert found == [[k, *r] for k, d in enumerate(docs) for r in plain_runs(d)]


def test_chance_equalities_of_fingerprints_change_nothing(monkeypatch):
    """With fingerprints that often agree by chance, words decide."""
    monkeypatch.setattr(periodic, "PRIMES", (7, 11))
    docs = [made(k, 90) for k in range(20)]
    ids = np.array(["abcdefgh".index(x) for d in docs for x in d], np.int32)
    found = periodic._found(ids, np.array([len(d) for d in docs]), 6, 4).tolist()
    assert found == [[k, *r] for k, d in enumerate(docs) for r in plain_runs(d)]


def test_query_equals_the_plain_version(spark, sf):
    rows = [tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(rows) == sorted(plain_row(*r) for r in docs)
    assert sum(r[1] > 0 for r in rows) > len(rows) / 20


def test_nulls_repeats_white_space_and_odd_columns(spark):
    texts = [None, "", " \t\n ", "no no no no no no", "a a a\x0ba\x0ca a\ta  a", "é è " * 6 + "!", "no no no no no no", "x " * 70_000]
    docs = spark.createDataFrame([(k if k != 2 else None, t, 7, 8) for k, t in enumerate(texts)], "`doc.id` int, `the``text` string, id int, runs int")
    got = {(r["doc.id"], r["n_words"]): r for r in periodic.periodic_runs(docs, "doc.id", "the`text").collect()}
    runs = {k[0]: [tuple(x) for x in r["runs"]] for k, r in got.items()}
    assert runs == {0: [], 1: [], None: [], 3: [(0, 6, 1)], 4: runs[4], 5: [(0, 12, 2)], 6: [(0, 6, 1)], 7: [(0, 70_000, 1)]}
    assert runs[4] == plain_runs(texts[4].encode().split())
    assert got[3, 6]["collapsed"] == "no" and got[5, 13]["collapsed"] == "é è !" and got[None, 0]["collapsed"] == ""
    assert periodic.periodic_runs(docs.limit(0), "doc.id", "the`text").count() == 0


def test_a_run_needs_two_periods(spark):
    with pytest.raises(ValueError, match="periods"):
        periodic.periodic_runs(spark.createDataFrame([], "doc_id int, text string"), least=6, times=1)
