"""The distance beyond which op5 rejects."""

import random

from tidemark.llm import rules


def test_moderate_outliers_are_rejected(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "|" * (k < 36) for k in range(60)), "en", "s") for i in range(10)]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    junk = [r for r in got if r["doc_id"] >= 1000]
    assert any(33.4 < r["d2"] <= 60 for r in junk)
    assert all(r["kept"] == (r["d2"] <= 33.3768) for r in got if abs(r["d2"] - 33.3768) > 0.001)
    assert all(r["kept"] for r in got if r["doc_id"] < 1000)
