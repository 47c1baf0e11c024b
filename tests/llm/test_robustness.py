"""Clashing column names, ids that are no numbers, repeated ids, and very long texts."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near, simhash, suffix, toxicity


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(n))


CLASHING = "_id string, _tie string, _spans string, _keep int, keep int, _kept_tie int, _score string, score int, _hits int, text string, doc_id long, start int, base int, gram string, fp int"


def clashing(spark):
    rng = random.Random(2)
    passage = say(rng, 60)
    texts = [passage + " " + say(rng, 30), say(rng, 40), say(rng, 25) + passage, "", None]
    return spark.createDataFrame([("x", "y", "z", 1, 2, 3, "s", 4, 5, t, i, 6, 7, "g", 8) for i, t in enumerate(texts)], CLASHING)


@pytest.mark.parametrize("operator", [suffix.without_repeats, simhash.near_duplicates, near.without_near_copies])
def test_clashing_names(spark, operator):
    docs = clashing(spark)
    got = operator(docs)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert {0, 1, 2} <= set(rows) and all((r["_id"], r["_spans"], r["keep"], r["_hits"]) == ("x", "z", 2, 5) for r in rows.values())


def test_clashing_names_of_a_score(spark):
    docs = clashing(spark).withColumn("toxic_score", F.lit("t"))
    got = toxicity.without_toxic(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"))
    assert got.columns == docs.columns and {r["toxic_score"] for r in got.collect()} <= {"t"}


def test_clashing_names_of_hits(spark):
    docs = clashing(spark).withColumn("hit_tie", F.lit("t"))
    item = docs.where("doc_id = 1").first()["text"]
    got = decontaminate.decontaminate(docs, spark.createDataFrame([("i", item)], "item_id string, text string"))
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 2, 3, 4]


def test_text_ids_order_as_texts(spark):
    rng = random.Random(5)
    passage = say(rng, 80)
    docs = spark.createDataFrame([("b", "x " + passage), ("a10", passage), ("a9", passage + " y"), (None, "short")], "doc_id string, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in suffix.repeats(docs).collect()}
    assert got == {None: 0, "a10": 0, "a9": len(passage), "b": len(passage)}
    found = {r["doc_id"]: r["component_id"] for r in simhash.simhash(docs.withColumn("text", F.lit("same"))).collect()}
    assert found == dict.fromkeys(found, "a10")


def test_one_row_of_a_repeated_id_stays(spark):
    docs = spark.createDataFrame([(1, "b text"), (1, "a text"), (1, "a text"), (2, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in simhash.near_duplicates(docs).collect()) == [(1, "a text"), (2, "c")]


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(7)
    spaced = say(rng, 900_000)[:5_000_000]
    solid = "".join(rng.choices("abcdefghij", k=5_000_000))
    return [spaced, solid]


def test_very_long_texts(spark, long_texts):
    spaced, solid = long_texts
    docs = spark.createDataFrame([(0, spaced), (1, solid), (2, solid[1_000_000:1_100_000] + "!"), (3, spaced[-500:])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix.repeats(docs).collect()}
    assert got == {0: (5_000_000, 0), 1: (5_000_000, 0), 2: (100_001, 100_000), 3: (500, 500)}
    prints = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.simhash(docs).collect()}
    assert prints[1] == xxhash.xxh64_intdigest(solid.encode(), 42)
    assert {r["doc_id"] for r in near.without_near_copies(docs).collect()} == {0, 1, 2, 3}


def test_crowds_of_equal_and_of_different_units(spark):
    """A passage in all documents, between texts that differ: crowded grams with equal and with different units."""
    rng = random.Random(11)
    passage = say(rng, 40)
    texts = [say(rng, 12) + passage + say(rng, 12) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        want[i] = hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest()
    _, once, place = suffix.keyed(docs)
    lists = suffix.repeated_spans(once, place, part_bytes=900).groupBy("_id").agg(F.collect_list(F.struct("start", "size")).alias("_spans"))
    got = docs.join(lists, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "_spans").mapInArrow(suffix.summary, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    assert {r["doc_id"]: r["kept_sha256"] for r in got.collect()} == want
