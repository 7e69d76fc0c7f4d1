"""Near copies of a text that isn't there itself: many sets that all share most shingles and are partly too far apart."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash
from tests.llm import brute
from tests.llm.test_dedup import copies, frame


def crowd(rng, n, edits=(1, 2, 2, 3, 3, 3, 4), length=150):
    pool = [f"w{k}" for k in range(3000)]
    base, docs = rng.choices(pool, k=length), {}
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(length)] = f"{rng.choice(pool)}x{rng.randrange(1000)}"
        docs[i] = " ".join(w)
    return docs


def most_joined(spark, since):
    """The most rows that a join of the executions from number `since` on made."""
    store = spark._jsparkSession.sharedState().statusStore()
    most, executions = 0, store.executionsList()
    for i in range(executions.size()):
        at = executions.apply(i).executionId()
        if at < since:
            continue
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            metrics = node.metrics()
            for m in map(metrics.apply, range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined():
                    most = max(most, int(values.get(m.accumulatorId()).get().replace(",", "")))
    return most


def executions(spark):
    all_ = spark._jsparkSession.sharedState().statusStore().executionsList()
    return 1 + max((all_.apply(i).executionId() for i in range(all_.size())), default=-1)


def test_a_crowd_is_not_compared_all_with_all(spark):
    """Equal to brute force; no join makes more rows than sets have shingles, though most sets are near to few others only."""
    docs = crowd(random.Random(1), 700)
    since = executions(spark)
    got = {r.doc_id: r.component_id for r in minhash.near_groups(frame(spark, docs.items())).collect()}
    assert got == brute.near(docs, 5)
    per_set = most_joined(spark, since) / len(docs)
    assert 0 < per_set < 150


@pytest.mark.parametrize("often", [2, 8])
@pytest.mark.parametrize("seed", range(2))
def test_sets_compared_by_differences_equal_brute_force(spark, monkeypatch, often, seed):
    """Crowds of other sizes, crowds around several texts, shared passages; also where few sets make a shingle a common one."""
    monkeypatch.setattr(minhash, "OFTEN", often)
    rng = random.Random(seed)
    docs = list(copies(rng, 150).values())
    for edits, length in (((0, 1, 2, 3), 60), ((2, 3, 4), 150), ((3,), 150), ((1,), 30), ((4, 5, 6), 200)):
        some = list(crowd(rng, 40, edits, length).values())
        docs += some + [x + " " + " ".join(f"t{rng.randrange(40)}" for _ in range(rng.randrange(12))) for x in some[:10]]
    rng.shuffle(docs)
    docs = dict(enumerate(docs))
    got = {r.doc_id: r.component_id for r in minhash.near_groups(frame(spark, docs.items()), size=4 + seed).collect()}
    assert got == brute.near(docs, 4 + seed)


def test_differences_tell_near_sets(spark):
    """Twice (100 + percent) times the differences that two sets share is the sum of their `far` at least, just where they are near."""
    rng = random.Random(2)
    sets = [sorted(set(range(40)) - set(rng.sample(range(40), rng.randint(0, 6))) | set(rng.sample(range(40, 60), rng.randint(0, 4)))) for _ in range(60)]
    apart = spark.createDataFrame([(7, 0, k, len(s), k) for k, s in enumerate(sets)], "bucket long, part long, cid long, n long, component long")
    common = spark.createDataFrame(list(enumerate(sets)), "cid long, common array<long>")
    rows = {r.cid: r for r in minhash._differences(apart, common, 80).collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len({*a} & {*b})
            near = both * 100 >= (len(a) + len(b) - both) * 80
            if i in rows and j in rows:
                assert near == (len({*rows[i].differ} & {*rows[j].differ}) * 360 >= rows[i].far + rows[j].far)
            else:
                assert not near
    assert len(rows) > 30 and spark.createDataFrame(list(rows.values())).select(F.max("size")).first()[0] < 20
