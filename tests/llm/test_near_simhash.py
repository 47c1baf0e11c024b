"""The near-copy stage gets its rows by SimHash: fingerprints, their blocks, and pairs at the limit of 0.8."""

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import near, simhash


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(3)
    many = np.array([1, 2, 255, 256, 700, 4])
    hashes = rng.integers(0, 1 << 63, int(many.sum()), np.uint64)
    got = simhash.wide_fingerprints(hashes, many, 3)
    assert got.shape == (6, 192)
    for word in range(3):
        one = simhash.mix(simhash.mix(hashes + np.uint64(word + 1)) + np.uint64(word + 1))
        bits = (one[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        ends = np.cumsum(many)
        want = np.array([2 * bits[e - n : e].sum(axis=0, dtype=np.int64) > n for e, n in zip(ends, many, strict=True)])
        place = [k % 8 * 8 + k // 8 for k in range(64)]  # eight bits are counted at once
        assert (got[:, word * 64 : word * 64 + 64][:, place] == want).all()


def test_keys_are_blocks_of_the_fingerprint():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "tie": [0, 0], "text": [" ".join("w%d" % i for i in range(400)), ""]})
    bits, count = near.blocks(100_000)
    assert bits == 8 and near.blocks(20_000_000)[0] == 16
    out = next(near.sketches(bits, count)(iter([batch])))
    shingles = np.frombuffer(out.column(4)[0].as_py(), "<u4").astype(np.uint64)
    bit = simhash.wide_fingerprints(shingles, np.array([396]), -(-bits * count // 64))[0]
    want = [k << 32 | sum(int(b) << i for i, b in enumerate(bit[k * bits : k * bits + bits])) for k in range(count)]
    assert out.column(3).to_pylist() == [want, []]


def test_pairs_at_the_limit_are_found(spark):
    """300 pairs of similarity 0.8 or little more, of different lengths, among texts that have no near copy."""
    rng = random.Random(8)
    word = iter(range(10**9))
    say = lambda n: ["w%d" % next(word) for _ in range(n)]
    texts = []
    for k in range(300):
        n = rng.choice([20, 44, 104, 404])
        whole = say(n)
        most = (n - 4) // 9  # of n - 4 shingles so many may differ on both sides
        texts += [whole, whole[:-most] + say(most) if k % 2 else whole + say((n - 4) // 4)]
    alone = [say(rng.choice([20, 100, 400])) for _ in range(400)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + alone)]
    got = {r["doc_id"] for r in near.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {*range(0, 600, 2), *range(600, 1000)} <= got
    assert len(got) <= 700 + 2  # at 0.8 one pair of a thousand may have no equal block, more of very short texts
