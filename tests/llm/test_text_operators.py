"""The text operators against plain Python on awkward documents, and on empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import counts, decontaminate, encode, pieces, rules, simhash, suffix

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, start int, _score string"
SPACE, LETTER = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def corpus():
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "größe", "año", "tion", "ing", "x1", "日本", "I", "Ab", "cd"] + ["w%d" % i for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, copy = say(70), say(120)
    texts = [None, "", "   \n\t ", "a", "A B", "!!!", copy, copy, copy + " end", copy.replace("the", "le"), say(40) + "\n" + passage + "\n" + say(30), passage, say(10) + " " + passage, "é" * 150, "ab" * 400, "na " * 200, say(3000), "line one here\n" * 12, "\0\x01 odd \x7f bytes ▁ mark 😀", say(25) + "#$%&" * 9]
    texts += [say(rng.randrange(5, 60)) for _ in range(15)] + [passage[:99], passage[:100], passage[1:]]
    out = [(i * 3, t, "en" if i % 2 else None, "s", 1, 2, "clash") for i, t in enumerate(texts)]
    return [*out, out[7], out[16]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] or "" for r in corpus()}
ROWS = Counter(r[0] for r in corpus())


def same_rows(got, want, *columns):
    assert Counter(r["doc_id"] for r in got) == ROWS
    for r in got:
        assert tuple(r[c] for c in columns) == want[r["doc_id"]], r["doc_id"]


# --- SimHash


def fingerprint(text):
    words = SPACE.findall(lowered(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def grouped(prints, most=2):
    root = {i: i for i in prints}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def test_simhash(docs, none):
    prints = {i: fingerprint(t) for i, t in TEXTS.items()}
    groups = grouped(prints)
    got = simhash.simhash(docs).withColumn("u", F.lpad(F.hex("fp"), 16, "0")).collect()
    same_rows(got, {i: (f"{p:016X}", groups[i]) for i, p in prints.items()}, "u", "component_id")
    kept = simhash.near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values())) and kept.columns == docs.columns
    assert simhash.simhash(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def connected(values, links):
    root = {v: v for v in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def crowded_values():
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(60)} | {0}
    for v in [*values][:40]:  # chains of near neighbours, and a crowd that shares 48 bits
        for _ in range(5):
            v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {(0xABCDEF012345 << 16) | rng.getrandbits(16) for _ in range(150)}
    return [v - (1 << 64) if v >> 63 else v for v in values]


@pytest.mark.parametrize("fewest, most", [(25, 2), (1, 2), (8, 4)])
def test_near_links_lose_nothing(spark, fewest, most):
    signed = crowded_values()
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), most, fewest=fewest).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= most for r in links)
    want = grouped({v: v & (1 << 64) - 1 for v in signed}, most)
    assert connected(signed, [(r["a"], r["b"]) for r in links]) == want
    if fewest == 1:
        assert len(links) == len(signed) - len(set(want.values()))


def test_gray_index_finds_all():
    rng = np.random.default_rng(3)
    values = np.unique(np.r_[rng.integers(0, 1 << 63, 500).astype(np.uint64), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))])
    values = values[np.argsort(simhash.gray_rank(values))]
    found = [(i, j) for q, f in simhash.GrayIndex(values).within(values, 2) for i, j in zip(q.tolist(), f.tolist(), strict=True)]
    want = {(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 2)}
    assert set(found) == want and len(found) == len(want)
    ranks = simhash.gray_rank(np.arange(8, dtype=np.uint64) ^ (np.arange(8, dtype=np.uint64) >> np.uint64(1)))
    assert ranks.tolist() == list(range(8))
    assert list(simhash.GrayIndex(values[:0]).within(values, 2)) == []


def test_all_links_come_from_the_index(monkeypatch):
    """Two ranges of sf0.1's fingerprints: what the index is asked gives every link, and nothing else gives any."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).combine_chunks().to_batches()
    prints = np.unique(np.concatenate([b.column(1).to_numpy().view(np.uint64) for b in simhash.fingerprints(iter(texts))]))
    prints = prints[np.argsort(simhash.gray_rank(prints))]
    half = len(prints) // 2
    ranges = np.repeat([0, 1], [half, len(prints) - half])
    ends = [0, half]
    upper = tuple(np.array(x) for x in ([0, 1], np.bitwise_and.reduceat(prints, ends), np.bitwise_or.reduceat(prints, ends)))
    rows = pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), pa.array(prints.view(np.int64))], ["range", "fp"])
    asked, within = [], simhash.GrayIndex.within

    def counted(self, queries, most, skip=None):
        for q, f in within(self, queries, most, skip):
            asked.append(len(q))
            yield q, f

    def links():
        dealt = pa.Table.from_batches(list(simhash._visits((*upper, 2))(iter([rows])))).sort_by([("range", "ascending"), ("guest", "ascending")])
        return [(r["a"], r["b"]) for b in simhash._range_links(2)(iter(dealt.combine_chunks().to_batches())) for r in b.to_pylist()]

    monkeypatch.setattr(simhash.GrayIndex, "within", counted)
    found, signed = links(), prints.view(np.int64).tolist()
    assert 0 < len(found) <= sum(asked)
    pairs = [(signed[i], signed[i + 1 + j]) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 2)]
    assert len(pairs) > 3 and connected(signed, found) == connected(signed, pairs)
    monkeypatch.setattr(simhash.GrayIndex, "within", lambda self, *_: iter(()))
    assert links() == []


# --- suffix arrays


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(1)
    for size, letters in ((0, 1), (1, 1), (300, 1), (800, 2), (900, 26)):
        data = np.r_[x := rng.integers(0, letters, size).astype(np.uint8) + 97, x[: size // 2]]
        raw, order = data.tobytes(), suffix.suffix_order(data)
        assert sorted(order.tolist()) == list(range(len(raw)))
        assert [raw[i : i + 100] for i in order] == sorted(raw[i : i + 100] for i in range(len(raw)))
        wanted = rng.random(len(raw)) < 0.3
        assert [raw[i : i + 100] for i in suffix.suffix_order(data, 100, wanted)] == sorted(raw[i : i + 100] for i in np.flatnonzero(wanted))
        for k, shared in enumerate(suffix.common_prefixes(data, order)):
            a, b = raw[order[k] : order[k] + 100], raw[order[k + 1] : order[k + 1] + 100]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared == n


def repeats_of(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("part", [300, 1 << 19])
def test_repeats(docs, none, part, monkeypatch):
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (suffix.LENGTH, part))
    want = repeats_of(TEXTS)
    assert sum(w[1] for w in want.values()) > 1000
    same_rows(suffix.repeats(docs).collect(), want, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    cut = suffix.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    for r in cut.collect():
        if all(ord(c) < 128 for c in TEXTS[r["doc_id"]]):
            assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][3]
    assert suffix.repeats(none).count() == 0 and suffix.without_repeats(none).count() == 0


def test_long_documents_are_cut_without_loss(docs, monkeypatch):
    monkeypatch.setattr(suffix, "_PIECE", 777)
    owner = np.frombuffer(TEXTS[48].encode() * 2, np.uint8)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([0], pa.int32()), pa.array([owner.tobytes().decode()])], ["_id", "_tie", "base", "text"])
    rows = [r for b in suffix.unit_rows(100, 20)(iter([batch])) for r in b.to_pylist()]
    covered = sorted(x for r in rows if r["windows"] for x in range(r["start"], r["start"] + r["windows"]))
    assert covered == list(range(len(owner) - 99))


# --- benchmark passages


def hits_of(items, window=10):
    known = {}
    for i, t in items:
        w = LETTER.findall(lowered(t or ""))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            known.setdefault(tuple(w[k : k + window]), set()).update({str(i)} if i is not None else set())
    out = {}
    for d, t in TEXTS.items():
        w = LETTER.findall(lowered(t))
        hit, names = [0] * len(w), set()
        for size in {len(k) for k in known}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in known:
                    names |= known[tuple(w[k : k + size])]
                    hit[k : k + size] = [1] * size
        out[d] = (len(w), sum(hit), sorted(names))
    return out


@pytest.mark.parametrize("full", [False, True])
def test_contamination(spark, docs, none, full, monkeypatch):
    if full:  # a table that holds every token leaves all to the join
        monkeypatch.setattr(decontaminate, "bit_table", lambda _: np.packbits(np.ones(1 << decontaminate.TABLE_BITS, bool)))
    some = [t for t in TEXTS.values() if len(t.split()) > 20]
    items = [(1, " ".join(some[0].upper().split()[3:19])), (2, some[3]), (2, "of the"), (3, None), (4, "!!"), (5, "größe"), (None, " ".join(some[5].split()[:12])), (6, "日本 the"), (7, "never met " * 6)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, table).collect()
    same_rows(got, hits_of(items), "n_words", "n_hit", "items")
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, table).collect()) == sorted(i for i, (_, h, _) in hits_of(items).items() for _ in range(ROWS[i]) if not h)
    assert decontaminate.contamination(none, table).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(docs, table.limit(0)).collect())


# --- SentencePiece


def test_encoding_and_counts(docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = {i: library.encode(t) for i, t in TEXTS.items()}
    same_rows(encode.encode(docs, MODEL).collect(), {i: (x, library.decode(x)) for i, x in ids.items()}, "ids", "decoded")
    same_rows(counts.token_counts(docs, MODEL, 50).collect(), {i: (len(TEXTS[i].encode()), len(x), len(x) > 50) for i, x in ids.items()}, "n_bytes", "n_tokens", "over_limit")
    assert encode.encode(none, MODEL).count() == 0 and counts.token_counts(none, MODEL).count() == 0


@pytest.mark.parametrize("long", [128, 0])
def test_random_strings_encode_as_the_library_does(monkeypatch, long):
    monkeypatch.setattr(encode, "LONG", long)
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceModel(open(MODEL, "rb").read())
    encoder, counter, rng = encode.Encoder(model), counts.Counter(model), random.Random(8)
    for alphabet in ("ab", "etaoin  ", "▁ x", "éß日😀\n\t", "(){}=+-0123456789"):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80)))
            parts = pieces.segments(text)
            assert encoder.encode(parts)[0].tolist() == library.encode(text), text
            assert sum(map(counter.count, parts)) == len(library.encode(text)), text
    parts = ["".join(rng.choice(alphabet) for _ in range(3000)) for alphabet in ("ab", "etaoin", "aeiouthsn", "=-+", "日本語é")]
    ids, edges = encoder.encode([pieces.MARK + p for p in parts])
    for k, text in enumerate(parts):
        assert ids[edges[k] : edges[k + 1]].tolist() == library.encode(text)


def test_long_unbroken_texts_take_seconds():
    library, encoder, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), encode.Encoder(pieces.PieceModel(open(MODEL, "rb").read())), random.Random(3)
    import base64
    import time

    for text in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), base64.b64encode(rng.randbytes(750_000)).decode(), "ab" * 500_000, "の日本" * 300_000):
        began = time.perf_counter()
        ids = encoder.encode(pieces.segments(text))[0]
        assert time.perf_counter() - began < 60
        assert ids.tolist() == library.encode(text)


# --- quality rules


def test_base_rules(docs, none):
    want = {}
    for i, t in TEXTS.items():
        w = SPACE.findall(t)
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        many = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = [0] * len(w)
        for k in range(len(w) - 7):
            if many[tuple(w[k : k + 8])] > 1:
                hit[k : k + 8] = [1] * 8
        want[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(hit), len(w) < 20 or 100 * sum(hit) > 30 * len(w))
    got = rules.quality_rules(docs).collect()
    same_rows(got, want, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert rules.quality_rules(none).count() == 0


def estimated(x, floor):
    """Squared distances by the estimate of one group, its starts and steps written out in numpy."""
    size = x.shape[1]
    bins = lambda v: np.floor(np.minimum(v, rules._TOP) / rules._BIN)
    low = lambda v, share: np.sort(bins(v))[int(np.ceil(share * len(v) - 1e-9)) - 1]
    centre = np.array([(low(x[:, i], 0.5) + 0.5) * rules._BIN for i in range(size)])
    spread = np.array([(low(np.abs(x[:, i] - centre[i]), 0.5) + 0.5) * rules._BIN for i in range(size)])
    z = (x - centre) / np.maximum(1.4826 * spread, floor)
    length = np.sqrt((z**2).sum(axis=1) + 1e-9)
    starts = [length**2]
    for v in (np.tanh(z), z / length[:, None]):
        m = v.T @ v / len(v)
        scale = np.sqrt(np.diag(m) + 1e-9)
        root = np.linalg.cholesky(m / np.outer(scale, scale) + rules._CORRELATION_FLOOR * np.eye(size))
        starts.append((np.linalg.solve(root, z.T) ** 2).sum(axis=0))
    factor = rules.SUBSET / rules._chi_square(rules._chi_square_point(rules.SUBSET, size), size + 2)
    around = lambda rows, f: (rows.mean(axis=0), np.cov(rows.T, bias=True) * f + np.diag(floor**2))
    far = lambda mean, cov: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    best = []
    for d2 in starts:
        reached = np.inf
        while True:
            mean, cov = around(x[bins(np.log1p(d2)) <= low(np.log1p(d2), rules.SUBSET)], factor)
            logdet = np.linalg.slogdet(cov)[1] / 2
            if logdet >= reached - rules.SETTLED:
                break
            reached, kept, d2 = logdet, (mean, cov), far(mean, cov)
        best.append((reached, len(best), kept))
    mean, cov = min(best, key=lambda b: b[:2])[2]
    return far(*around(x[far(mean, cov) <= rules._chi_square_point(0.975, size)], 1.0))


def test_outliers_against_numpy(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "s%d" % (i % 2)) for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "#%&" for _ in range(60)), "en", "s0") for i in range(20)]
    rows += [(2000 + i, " ".join(word() + "#" * (i % 3) for _ in range(40)), None, "few") for i in range(9)] + [(3000, " ".join(word() for _ in range(30)), "de", None)]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 40.0).toPandas().set_index("doc_id")
    assert got.kept[(got.index < 1000) | (got.index == 3000)].all() and not got.kept[(got.index >= 1000) & (got.index < 2000)].any()
    floor = np.array(list(rules.STATISTICS.values()))
    assert got.grp.nunique() == 4
    for grp, part in got.groupby("grp"):
        if len(part) > 1:
            assert np.allclose(estimated(part[list(rules.STATISTICS)].to_numpy(float), floor), part.d2, rtol=1e-3, atol=1e-3), grp


def test_every_group_is_estimated_by_itself(spark):
    got = rules.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    whole = got.where("not base_failed").select("lang", "source").distinct().count()
    assert got.where("d2 is not null and not base_failed").select("lang", "source", "grp").distinct().count() == whole == 80
