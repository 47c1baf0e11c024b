"""The read floor of many steps and leases: right by brute force, and not by joining all of them."""

import random

from tidemark.functions import ordered
from tidemark.operators import compact
from tidemark.plans import catalogue

STEP, LEASE = "step long, frontier long", "step long, snapshot long, until long"


def floors(frontiers, leases, window):
    floor, policy, out = 0, 0, []
    for step in sorted({s for s, _ in frontiers}):
        policy = max(policy, max(f for s, f in frontiers if s == step) - window)
        held = [snapshot for since, snapshot, until in leases if until is not None and snapshot is not None and since <= step < until]
        floor = max(floor, min([policy, *held]))
        out.append((step, floor))
    return out


def test_leases_of_any_length_hold_the_floor(spark, monkeypatch):
    rng = random.Random(5)
    frontiers = [(step, 3 * step + rng.randrange(9)) for step in range(-40, 260) if step % 7] + [(50, 400), (260, 900)]
    frontiers = [(step, max(0, frontier)) for step, frontier in frontiers]
    leases = [(since, rng.randrange(800), since + rng.choice([-3, 0, 1, 2, 20, 90])) for since in rng.choices(range(-50, 260), k=60)]
    leases += [(-60, 700, 1 << 62), (10, 690, 250), (8, 1, 16), (16, 2, 32), (100, None, 200), (100, 5, None), (None, 5, 200)]
    known = [lease for lease in leases if lease[0] is not None]
    monkeypatch.setattr(ordered.least_alive, "__defaults__", (8,))
    got = compact.read_floor(spark.createDataFrame(frontiers, STEP).repartition(3), spark.createDataFrame(leases, LEASE).repartition(3), 60)
    assert sorted(map(tuple, got.collect())) == floors(frontiers, known, 60)
    none = compact.read_floor(spark.createDataFrame(frontiers, STEP), spark.createDataFrame([], LEASE), 60)
    assert sorted(map(tuple, none.collect())) == floors(frontiers, [], 60)


def test_steps_and_leases_are_not_joined_on_a_range(spark):
    plan = catalogue.QUERIES["read_floor"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
