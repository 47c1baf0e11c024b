"""Operators over whole tables: later rows count, and brute force where there is no SQL."""

import pytest

from tidemark.plans import catalogue
from tidemark.sources import derived as D

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return sorted((r["event_id"], r["user_id"]) for r in D.table(spark, FOLDER, "events").select("event_id", "user_id").collect())


def test_read_floor(spark, events):
    leases = [(i, i * 2, i + 1 + u % 40) for i, u in events if i % 9 == 0]
    want, policy, floor = [], 0, 0
    for i, _ in events:
        policy = max(policy, i * 3 - 60, 0)
        floor = max(floor, min([policy, *(s for a, s, b in leases if a <= i < b)]))
        want.append((i, floor))
    assert sorted(map(tuple, catalogue.QUERIES["read_floor"](spark, FOLDER).collect())) == want and len(want) > 500


def test_pending_depth(spark, events):
    done, rows = -1, []
    for i, _ in events:
        arrival = i - i % 10 + i * 3 % 10
        done = max(done, arrival)
        rows.append((arrival, done))
    want = max(sum(b <= a and d > a for b, d in rows) for a, _ in rows)
    assert catalogue.QUERIES["ticket_pending_depth"](spark, FOLDER).first()["depth"] == want


def test_later_rows_are_checked(spark):
    assert catalogue.QUERIES["delta_lineage_check"](spark, FOLDER).where("after >= 4000").count() > 0
    assert {r["verdict"] for r in catalogue.QUERIES["snap_certificates"](spark, FOLDER).collect()} == {"Approve", "Retry"}
    reads = catalogue.QUERIES["serial_read_deps"](spark, FOLDER)
    assert reads.where("txn % 3 <> 0").count() > 0
