"""Chat formatting: cumulative snapshots are collapsed, then conversations are rendered.

Logs often hold a conversation again each time it grows. Rolling hashes of the turns so far name every
prefix of every conversation; one whose whole is a proper prefix of a longer one goes, by an
anti-join, and of equal ones the smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Text before a turn's role, between role and text, and after the text.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _turns(log: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, key): key orders turns that share a number."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return log.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("key", F.xxhash64("role", "text"))


def prefixes(log: DataFrame) -> DataFrame:
    """(conv_id, n, one, two, last): the hashes of each conversation's first n turns.

    A turn's two 64-bit hashes cover its place, and a prefix's are their exclusive or, so that they roll on
    with a running aggregate.
    """
    ordered = Window.partitionBy("conv_id").orderBy("turn", "key", "other")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = _turns(log).select("conv_id", "turn", "key", F.xxhash64(F.lit("other"), "text", "role").alias("other"))
    rows = rows.withColumn("n", F.row_number().over(ordered)).withColumn("last", F.lead("key").over(ordered).isNull())
    return rows.select("conv_id", "n", F.bit_xor(F.xxhash64("n", "key", "other")).over(so_far).alias("one"), F.bit_xor(F.xxhash64("other", "key", "n")).over(so_far).alias("two"), "last")


def maximal(log: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same): conversations that are no prefix of a longer one, equal ones once."""
    rolled = prefixes(log)
    whole = rolled.where("last").groupBy("n", "one", "two").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    inner = rolled.where("not last").select("n", "one", "two").distinct()
    return whole.join(inner, ["n", "one", "two"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_same")


def render(log: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, n_same, text) of each maximal conversation in ``log`` (conv_id, turn, role, text).

    Turns go by number, those that share one by a hash of role and text; repeated rows are turns
    of their own. Null roles and texts are empty, null turn numbers come first, rows without
    a conv_id are left out. A conversation is one row, so its turns meet in one task.
    """
    before, between, after = template
    turns = F.sort_array(F.collect_list(F.struct("turn", "key", "role", "text")))
    text = F.array_join(F.transform(turns, lambda t: F.concat(F.lit(before), t["role"], F.lit(between), t["text"], F.lit(after))), "")
    kept = maximal(log)
    return _turns(log).join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(text.alias("text")).join(kept, "conv_id").select("conv_id", "n_turns", "n_same", "text")
