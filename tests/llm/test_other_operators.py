"""Classifiers on held-out rows, archives, conversations, components and the pipeline."""

import base64
import hashlib
import importlib.util
import os
import random
import sys
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, quality, queries, toxicity, warc
from tidemark.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1080)] + [(3, 3), (7, 6), (7, 6)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: find(i) for i in root} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def labelled(spark, n=900):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic, good = i % 5 == 0, i % 4 != 1
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["zorgish", "krimpel", "vexwump"])
        docs.append((i, " ".join(text) if good else " ".join(w + "##!" for w in text), "x", 5.0))
        labels.append((i, int(good), int(toxic)))
    docs += [(5000, None, "x", 1.0), (5001, "", "x", 1.0), (None, "plain", "x", 1.0), docs[0]]
    labels += [(5002, 1, 1), (None, 1, 1), (7, None, None), labels[3]]
    return spark.createDataFrame(docs, "doc_id long, text string, y string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("operator, label, limit", [(toxicity.toxicity, "toxic", 0.7), (quality.quality, "quality", 0.5)])
def test_classifiers_on_held_out_rows(spark, operator, label, limit):
    docs, labels = labelled(spark)
    got = operator(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None}
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 200
    assert np.mean([(r["score"] >= limit) == bool(truth[r["doc_id"]]) for r in held]) > 0.95
    again = {r["doc_id"]: r["score"] for r in operator(docs, labels).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in got)
    one = operator(docs, labels.where(f"{label} = 1")).collect()
    assert len(one) == docs.count()
    assert operator(docs.limit(0), labels).count() == 0 and operator(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_against_a_plain_fit(spark, monkeypatch):
    """Weights by partition-summed slopes equal those of a plain dense logistic regression on log-count ratios of a few texts."""
    from tidemark.llm import labelled as training

    monkeypatch.setattr(toxicity, "_curve", lambda margin, y: (1.0, 0.0))
    docs, labels = labelled(spark, 240)
    got = toxicity.fit(docs, labels)
    rows = training.sample(docs, labels, "toxic").select("y", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.ASIDE)) == 0).alias("aside")).where("not aside").collect()
    grams = [{t[i : i + n] for t in [" " + " ".join(r["text"].lower().split()) + " "] for n in toxicity.GRAMS for i in range(len(t) - n + 1)} for r in rows]
    names = {g: k for k, g in enumerate(sorted(set().union(*grams)))}
    x = np.zeros((len(rows), len(names)))
    for k, found in enumerate(grams):
        x[k, [names[g] for g in found]] = 1
    y = np.array([r["y"] for r in rows], float)
    yes, even = y.sum(), toxicity.SMOOTHING / y.sum()
    x *= np.log((x[y == 1].sum(axis=0) / yes + even) / (x[y == 0].sum(axis=0) / (len(y) - yes) + even))
    share = np.where(y > 0, 0.5 / yes, 0.5 / (len(y) - yes))

    def at(w):
        z = x @ w[:-1] + w[-1]
        error = share * (1 / (1 + np.exp(-z)) - y)
        return share @ np.logaddexp(0, np.where(y > 0, -z, z)) + toxicity.PENALTY / 2 * w[:-1] @ w[:-1], np.r_[x.T @ error + toxicity.PENALTY * w[:-1], error.sum()]

    w = toxicity.minimise(at, np.zeros(len(names) + 1))
    raw = [r["text"].encode() for r in rows]
    found = toxicity.Features().of(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    margins = np.array([got.weights[f].sum() + got.bias for f in found])
    # the fixed space has few collisions here, and numbers of 32 bits
    assert np.corrcoef(margins, x @ w[:-1] + w[-1])[0, 1] > 0.999


def test_character_features():
    texts = ["Ab  C\nd", "日本語日本語です", "", "e\u0301é"]
    raw = [t.encode() for t in texts]
    got = [len(f) for f in toxicity.Features().of(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])]
    padded = [" " + " ".join(t.lower().split()) + " " for t in texts]
    assert got == [len({t[i : i + n] for n in toxicity.GRAMS for i in range(len(t) - n + 1)}) for t in padded]


def test_isotonic():
    y = np.array([0.0, 0.5, 0.2, 0.9, 0.8, 1.0])
    got = quality.isotonic(np.arange(6), y, np.ones(6))
    assert np.allclose(got, [0, 0.35, 0.35, 0.85, 0.85, 1])


def test_warc(spark):
    pages = [(1, "http://a", "<p>é"), (2, None, "<p>é"), (9, "u\r\nWARC-Type: fake", "<p>é"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "once"), (9, "u\r\nWARC-Type: fake", "<p>é"), (None, "n", "lost")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    archive = warc.write(df)
    got = warc.read(spark, archive).collect()
    most = {}
    for i, _, h in pages:
        most[h or ""] = max(most.get(h or "", i or -1), i or -1)
    want = []
    for i, _, h in pages:
        owner = most[h or ""] if most[h or ""] >= 0 else None
        want.append((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if owner == i else "revisit", str(None if owner == i else owner)))
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == sorted(want)
    stored = spark.read.parquet(archive.payloads)
    assert stored.count() == stored.select("sha256").distinct().count() == len({h or "" for _, _, h in pages})
    for r in warc.records(spark, archive).collect():
        length = int(r["header"].split("Content-Length: ")[1].split("\r\n")[0])
        assert len(bytes(r["block"])) == length and r["header"].endswith("\r\n\r\n")
    small = warc.read(spark, warc.write(df, least_bytes=5)).collect()
    assert sum(r["record_type"] == "revisit" for r in small) == 2
    assert warc.read(spark, warc.write(df.limit(0))).count() == 0


def test_damaged_payload_is_found(spark):
    archive = warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"))
    spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(), b"y")], "sha256 string, payload binary").write.mode("overwrite").parquet(archive.payloads)
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, archive).collect()


def test_chat(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "")]
    logs = {1: base[:2], 2: base, 3: base[:3], 4: base, 5: [("user", "hi")], 6: [("user", "hi"), ("assistant", "hello!")], 7: base[1:2]}
    rows = [(c, t, r, x, "clash") for c, turns in logs.items() for t, (r, x) in enumerate(turns)] + [(None, 0, "user", "lost", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string").repartition(4)
    got = {r["conv_id"]: (r["n_turns"], r["n_same"], r["text"]) for r in chat.render(df).collect()}
    text = lambda turns: "".join(f"<|im_start|>{r}\n{x or ''}<|im_end|>\n" for r, x in turns)
    assert got == {2: (4, 2, text(base)), 6: (2, 1, text(logs[6])), 7: (1, 1, text(logs[7]))}
    twice = spark.createDataFrame([(1, 0, "user", "a", "")] * 2, df.schema)
    assert chat.render(twice).collect()[0]["n_turns"] == 2
    assert chat.render(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pipeline():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "corpus_pipeline.py")
    spec = importlib.util.spec_from_file_location("corpus_pipeline", path)
    module = importlib.util.module_from_spec(spec)
    sys.modules["corpus_pipeline"] = module
    spec.loader.exec_module(module)
    return module


def test_pipeline(spark, pipeline):
    """Each stage's decisions take effect on what the one before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(pipeline.STAGES):
        after = stage(spark, docs, FOLDER).cache()
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        left = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert left <= ids
        if name == "toxicity":
            scores = toxicity.with_score(docs, toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")), "s")
            assert left == {r["doc_id"] for r in scores.where("s < 0.7").collect()}
        if name in ("passage_dedup", "tokens"):
            assert left == ids
        if number + 1 < len(pipeline.STAGES):
            assert after.columns == columns
        docs = after
    assert {r["doc_id"] for r in pipeline.run(spark, FOLDER).select("doc_id").collect()} == left
    assert {"doc_id", "ids", "n_tokens"} <= set(docs.columns)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_against_duckdb(spark, name):
    import duckdb

    connection = duckdb.connect()
    for t in ("pages", "conversations"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = queries.queries()[name](spark, FOLDER).toPandas(), connection.execute(queries.SQL[name]).df()
    show = lambda x: None if pd.isna(x) else str(int(x)) if isinstance(x, (int, float, np.number)) else str(x)
    rows = lambda f: sorted(map(str, (tuple(map(show, r)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))))
    assert rows(got) == rows(want)
