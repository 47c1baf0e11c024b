"""Quality rules: robust multivariate outliers, in DataFrame functions only.

Fixed rules come first. Documents that pass them are held against others of their language and source: a
minimum-covariance-determinant estimate of centre and scatter for each, and rejection by Mahalanobis distance.
Three deterministic starts (coordinates apart, correlations of tanh scores, of spatial signs) are concentrated for all
groups at once until no determinant falls any more, and the smallest determinant wins. Every group has the same formula,
whatever its size: the covariance of its central rows plus a floor, which dominates where rows are few.

A step is aggregates with map-side sums over rows of a few numbers, so a hot group gives each task one partial row.
Quantiles come from histograms of fixed bins, so they are exact in the bins, add up over partitions, and
have bounded size whatever the group. Estimates are joined by key; Spark broadcasts them only while their size is small.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spill

FEWEST_WORDS, REPEAT_WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: Transformed statistics, with the least standard deviation that each is given.
STATISTICS = {"word_length": 0.15, "symbol_rate": 0.05, "line_repeats": 0.15, "word_repeats": 0.15}
SUBSET = 0.75
#: Share of a normal group that lies within the cutoff.
LEVEL = 0.999999
#: Concentration ends for a group and start once the determinant's logarithm falls by less.
SETTLED = 1e-3
STARTS = 3
_BIN, _TOP = 1 / 128, 20.0
_CORRELATION_FLOOR = 0.1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """How many of the words are in a window of REPEAT_WINDOW words that occurs twice or more."""
    w = REPEAT_WINDOW

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - w), lambda i: F.struct(F.xxhash64(*[F.get(hashes, i + k) for k in range(w)]).alias("h"), i.alias("p")))

    def twice(found: Column) -> Column:
        hit = F.filter(found, lambda x, i: (F.get(found, i - 1)["h"] == x["h"]) | (F.get(found, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(hit, lambda x: x["p"]))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(w), F.coalesce(F.get(places, i + 1) - p, F.lit(w)))), F.lit(0), lambda a, x: a + x)

    counted = let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(F.sort_array(windows(h)), lambda s: let(twice(s), covered)))
    return F.when(F.size(words) > w, counted).otherwise(0).cast("long")


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed).

    Null texts have no words and fail. Windows are compared by 64-bit hashes of words' hashes.
    """
    space = " \t\n\u000b\f\r"
    text = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    bare = F.translate("text", space, "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, space, "")) > 0)
    words = F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    out = text.select(
        "doc_id",
        "lang",
        "source",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("repeated"))).alias("words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("same"))).alias("lines"),
    )
    n, repeated = F.col("words.n"), F.col("words.repeated")
    return out.select("doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.same").alias("n_dup_lines"), repeated.alias("n_repeat_words"), ((n < FEWEST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)).alias("base_failed"))


def _transformed() -> dict[str, Column]:
    share = {
        "word_length": F.log(F.col("word_chars") / F.greatest("n_words", F.lit(1)) + 1),
        "symbol_rate": F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "line_repeats": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "word_repeats": F.sqrt(F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))),
    }
    return {name: share[name] for name in STATISTICS}


def _bin(value: Column) -> Column:
    return F.floor(F.least(value, F.lit(_TOP)) / _BIN)


def _quantile(rows: DataFrame, keys: list[str], bin: Column, share: float, name: str) -> DataFrame:
    """Per ``keys`` the first bin up to which at least ``share`` of the values lie."""
    bins = rows.select(*keys, bin.alias("bin")).groupBy(*keys, "bin").count()
    total = F.sum("count").over(Window.partitionBy(*keys))
    return bins.withColumn("reached", F.sum("count").over(Window.partitionBy(*keys).orderBy("bin")) >= share * total).where("reached").groupBy(*keys).agg(F.min("bin").alias(name))


def _per_coordinate(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """Per group the medians of ``values`` as columns ``name``_i, of one histogram for all."""
    stacked = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _bin(v).alias("b")) for i, v in enumerate(values)])).alias("x")).select("grp", F.col("x.i").alias("i"), F.col("x.b").alias("b"))
    middle = _quantile(stacked, ["grp", "i"], F.col("b"), 0.5, "middle")
    return middle.groupBy("grp").agg(*[F.max(F.when(F.col("i") == i, (F.col("middle") + 0.5) * _BIN)).alias(f"{name}_{i}") for i in range(len(values))])


def _with_root(moments: DataFrame, cov: Callable[[int, int], Column], name: str) -> DataFrame:
    """``moments`` with the lower root ``name``_ij of a covariance, one column at a time, so that no expression holds another's many times over."""
    size = len(STATISTICS)
    for i in range(size):
        for j in range(i + 1):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - F.col(f"{name}_{i}{k}") * F.col(f"{name}_{j}{k}")
            moments = moments.withColumn(f"{name}_{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"{name}_{j}{j}"))
    return moments


def _roots(name: str) -> list[str]:
    return [f"{name}_{i}{j}" for i in range(len(STATISTICS)) for j in range(i + 1)]


def _distance(rows: DataFrame, values: list[Column], root: str, name: str) -> DataFrame:
    """``rows``, which hold a root, with the squared length ``name`` of ``values`` under its inverse."""
    for i, value in enumerate(values):
        rest = value
        for k in range(i):
            rest = rest - F.col(f"{root}_{i}{k}") * F.col(f"_z_{k}")
        rows = rows.withColumn(f"_z_{i}", rest / F.col(f"{root}_{i}{i}"))
    return rows.withColumn(name, sum((F.col(f"_z_{i}") ** 2 for i in range(1, len(values))), F.col("_z_0") ** 2)).drop(*[f"_z_{i}" for i in range(len(values))])


def _estimate(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Per ``keys`` mean m_i, lower root l_ij of the covariance times ``factor`` plus the floor, and logdet."""
    names, floor = list(STATISTICS), list(STATISTICS.values())
    size = len(names)
    sums = [F.avg(F.col(names[i])).alias(f"m_{i}") for i in range(size)]
    sums += [F.avg(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}{j}") for i in range(size) for j in range(i + 1)]
    out = _with_root(rows.groupBy(*keys).agg(*sums), lambda i, j: (F.col(f"s_{i}{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * factor + (floor[i] ** 2 if i == j else 0.0), "l")
    return out.select(*keys, *[f"m_{i}" for i in range(size)], *_roots("l"), sum((F.log(f"l_{i}{i}") for i in range(1, size)), F.log("l_00")).alias("logdet"))


def _with_distance(rows: DataFrame, estimate: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` with the squared Mahalanobis distance ``d2``, null without an estimate."""
    joined = rows.join(estimate, keys, how)
    return _distance(joined, [F.col(n) - F.col(f"m_{i}") for i, n in enumerate(STATISTICS)], "l", "d2").select(*rows.columns, "d2")


def _started(learn: DataFrame) -> DataFrame:
    """``learn`` once for each start, with the squared distance ``d2`` that the start gives."""
    names, floor = list(STATISTICS), list(STATISTICS.values())
    size = range(len(names))
    centre = spill(_per_coordinate(learn, [F.col(n) for n in names], "c"), "rules-centre")
    spread = spill(_per_coordinate(learn.join(centre, "grp"), [F.abs(F.col(n) - F.col(f"c_{i}")) for i, n in enumerate(names)], "v").join(centre, "grp"), "rules-spread")
    scored = learn.join(spread, "grp")
    for i, n in enumerate(names):
        scored = scored.withColumn(f"_s_{i}", (F.col(n) - F.col(f"c_{i}")) / F.greatest(1.4826 * F.col(f"v_{i}"), F.lit(floor[i])))
    scored = scored.select("grp", *names, *[f"_s_{i}" for i in size])
    length = F.sqrt(sum((F.col(f"_s_{i}") ** 2 for i in size), F.lit(1e-9)))
    kinds = {"t": [F.tanh(f"_s_{i}") for i in size], "g": [F.col(f"_s_{i}") / length for i in size]}
    moments = scored.groupBy("grp").agg(*[F.avg(v[i] * v[j]).alias(f"{k}m_{i}{j}") for k, v in kinds.items() for i in size for j in range(i + 1)])
    for k in kinds:  # correlations
        moments = _with_root(moments, lambda i, j, k=k: F.col(f"{k}m_{i}{j}") / F.sqrt((F.col(f"{k}m_{i}{i}") + 1e-9) * (F.col(f"{k}m_{j}{j}") + 1e-9)) + (_CORRELATION_FLOOR if i == j else 0.0), k)
    moments = spill(moments.select("grp", *_roots("t"), *_roots("g")), "rules-starts")
    out = scored.join(moments, "grp").withColumn("d_0", length**2)
    for number, k in enumerate(kinds, 1):
        out = _distance(out, [F.col(f"_s_{i}") for i in size], k, f"d_{number}")
    return out.select("grp", *names, F.explode(F.array(*[F.struct(F.lit(k).alias("start"), F.col(f"d_{k}").alias("d2")) for k in range(STARTS)])).alias("x")).select("grp", *names, "x.*")


def _concentrated(learn: DataFrame) -> DataFrame:
    """Per group the estimate of the smallest determinant that concentration reaches from any start."""
    inside = _chi_square_point(SUBSET, len(STATISTICS))
    factor = SUBSET / _chi_square(inside, len(STATISTICS) + 2)
    keys, rows = ["grp", "start"], None
    near, best = spill(_started(learn), "rules-near"), None
    rows = near.drop("d2")
    while True:
        limit = _quantile(near, keys, _bin(F.log1p("d2")), SUBSET, "limit")
        half = near.join(limit, keys).where(_bin(F.log1p("d2")) <= F.col("limit"))
        now = spill(_estimate(half, keys, factor), "rules-estimate")
        if best is None:
            best, active = now, now
        else:
            falls = now.join(best.select(*keys, F.col("logdet").alias("before")), keys)
            active = falls.where(F.col("logdet") < F.col("before") - SETTLED).drop("before")
            best = spill(best.unionByName(active).groupBy(*keys).agg(F.min_by(F.struct(*best.columns), "logdet").alias("e")).select("e.*"), "rules-best")
        active = spill(active, "rules-active")
        if active.isEmpty():
            return best.groupBy("grp").agg(F.min_by(F.struct(*best.columns), F.struct("logdet", "start")).alias("e")).select("e.*").drop("start", "logdet")
        near = _with_distance(rows, active, keys, "inner")


def _chi_square(x: float, degrees: int) -> float:
    """Distribution function for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def _chi_square_point(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle, degrees) < share else (low, middle)
    return low


#: Squared distance over which a document is rejected: the chi-square point of LEVEL for four values, 33.4.
CUTOFF = _chi_square_point(LEVEL, len(STATISTICS))


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``base`` of each row of ``docs`` with grp (language and source), the statistics, d2 (squared distance) and kept.

    Null lang and source are values like any other. Documents that fail the fixed rules are estimated from
    nowhere and kept nowhere. Repeated rows count as often as they occur. In a group of one or of equal documents the
    floor alone is the scatter. Other columns, whatever their names, are left out; a very long text is one row's work.
    """
    rows = base(docs)
    for name, value in _transformed().items():
        rows = rows.withColumn(name, value)
    rows = spill(rows.withColumn("grp", F.to_json(F.struct("lang", "source"))), "rules")
    learn = rows.where("not base_failed").select("grp", *STATISTICS)
    estimate = spill(_concentrated(learn), "rules-estimate")
    # once more over all that lie near: the usual reweighting
    near = _with_distance(learn, estimate, ["grp"])
    estimate = spill(_estimate(near.where(F.col("d2") <= _chi_square_point(0.975, len(STATISTICS))), ["grp"], 1.0), "rules-estimate")
    out = _with_distance(rows, estimate, ["grp"])
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True)))
