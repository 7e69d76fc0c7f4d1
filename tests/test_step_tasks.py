"""Steps of profiles: a task's share of the rows doesn't grow with the table."""

from tessera.operators import profile
from tessera.plans import QUERIES


def test_tasks_grow_with_the_profiles(spark, sf, monkeypatch):
    monkeypatch.setattr(profile, "PROFILES", 100, raising=False)
    steps = QUERIES["expanded_steps"][0](spark, sf)
    share = steps.select("event_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(share) == 1000 and len(share) == 10 and max(share) < 200
