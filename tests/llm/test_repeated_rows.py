"""op9 on rows that repeat both doc_id and text."""

import random

import pytest

from tidemark.llm import suffix


@pytest.mark.parametrize("parts", [1, 2])
def test_repeated_rows_are_one_document(spark, parts):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    alone, twice = say(60), say(60)
    rows = [(1, alone), (1, alone), (2, twice), (3, twice)]
    got = suffix.repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 0), (3, len(twice))]
