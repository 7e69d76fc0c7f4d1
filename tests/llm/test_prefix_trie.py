"""The trie of conversations against a plain version, however it is taken apart."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie, queries


def plain(convs):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len((path[-1][1] if path else "").encode().split())
        below = [out[k] for k in kids[path]]
        ends = ",".join(str(c) for c in sorted(members[path]) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out[path] = (min(members[path]), len(path), parent, len(members[path]), len(below), sum(r[5] for r in below) or 1, own + sum(r[6] for r in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def in_order(rows):
    """Turns of rows (conv_id, turn, role, text) as the operator orders them."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def got(found):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in found.select(*names).collect())


def made(seed, n=300):
    """Copies, shared beginnings, single and repeated turns, nulls, one long conversation."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rng.random()
        k = rng.randint(1, 6)
        shared = ["hi there", "how are you", "fine"] if kind < 0.6 else []
        texts = shared + ([] if kind < 0.2 else [rng.choice(["a b", "c", None, " ", "d e f"]) for _ in range(k)])
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", None]) if kind > 0.7 else "user", x) for t, x in enumerate(texts)]
    rows += [(1000, t, "user", f"turn {t // 2} of many") for t in range(60)] + [(None, 1, "user", "lost")] + rows[:3]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("most", "rounds", "shelf"), [(50_000, 12, 20_000), (5, 12, 7), (5, 2, 7), (1, 1, 1)])
def test_trie_equals_the_plain_one(spark, monkeypatch, most, rounds, shelf):
    for name, value in (("MOST", most), ("ROUNDS", rounds), ("SHELF", shelf)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = made(most + rounds, 300 if most > 5 else 60)
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(in_order(rows))


def test_query_equals_the_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = plain(rebuilt(in_order(rows)))
    assert got(queries.op13_prefix_trie(spark, sf)) == own and any(r[3] > 1 and r[1] for r in own)


def test_rebuilt_turnless_and_absent_heads(spark, tmp_path):
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(21, 60) for t in range(c % 4)] + [(40, 0, "a", "b c"), (20, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(queries.op13_prefix_trie(spark, str(tmp_path))) == plain(rebuilt(in_order(rows)))


def test_many_that_end_at_one_node(spark, monkeypatch):
    """Their digest comes from chunks that several tasks made."""
    copies = [(c, 0, "user", "the same") for c in range(30_000)] + [(c, 0, "user", f"x {c}") for c in range(40_000, 40_050)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = got(prefix_trie.prefix_trie(spark.createDataFrame(copies, SCHEMA).repartition(5)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found == plain(in_order(copies))


def test_empty_and_odd_columns(spark):
    rows = spark.createDataFrame([(1, 0, "u", "x", 5), (1, 1, "u", "y", 6)], "`a.b` int, n int, who string, `te``xt` string, path int")
    names = {"conv_col": "a.b", "turn_col": "n", "role_col": "who", "text_col": "te`xt"}
    assert got(prefix_trie.prefix_trie(rows, **names)) == plain({1: [("u", "x"), ("u", "y")]})
    assert got(prefix_trie.prefix_trie(rows.limit(0), **names)) == []
