"""Checks and analyses of a transaction log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running, with_previous


def last_write_before(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """``reads`` (k, at, ...) with ``wrote_at``: the newest write (k, v) of the key with v < at.

    One sort per key of reads and writes together, rather than a join of every read with every write.
    """
    other = [c for c in reads.columns if c not in ("k", "at")]
    both = reads.select("k", "at", F.struct(*other, F.lit(1).alias("_")).alias("r"), F.lit(None).cast("long").alias("w")).unionByName(writes.select("k", F.col("v").alias("at"), F.lit(None).alias("r"), F.col("v").cast("long").alias("w")))
    # at one version reads come first: they see only what is strictly older
    before = Window.partitionBy("k").orderBy("at", F.col("w").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("wrote_at", F.max("w").over(before)).where("r is not null").select("k", "at", *[f"r.{c}" for c in other], "wrote_at")


def conflicts(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(txn, conflict) for reads (txn, k, read_version, commit_version) against writes (k, v).

    A transaction conflicts if a key it read was written in (read_version, commit_version). Given the writes of
    committed transactions this validates a history; given those of all submitted ones it is the
    conservative variant, which may abort more.
    """
    seen = last_write_before(reads.withColumn("at", F.col("commit_version")).select("k", "at", "txn", "read_version"), writes)
    return seen.groupBy("txn").agg(F.coalesce(F.bool_or(F.col("wrote_at") > F.col("read_version")), F.lit(False)).alias("conflict"))


def execute(transactions: DataFrame) -> DataFrame:
    """(domain, txn, outcome) of transactions run in order within each domain: Committed or Conflict.

    Whether one conflicts depends on which before it committed, so a domain is a fold. Input is (domain,
    commit_version, txn, read_version, reads array<struct<s,e>>, writes array<bigint>). Rows
    of a domain arrive in batches in order; only its newest write per key is held.
    """

    ordered = transactions.repartition("domain").sortWithinPartitions("domain", "commit_version")
    kind = transactions.schema["domain"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for rows in batches:
            for domain, part in rows.groupby("domain", sort=False):
                if domain not in held:
                    held = {domain: {}}  # rows are sorted, so the domain before is done
                newest = held[domain]
                out = []
                for r in part.itertuples():
                    hit = any(newest.get(k, -1) > r.read_version for x in r.reads for k in range(x["s"], x["e"]))
                    if not hit:
                        newest.update(dict.fromkeys(r.writes, r.commit_version))
                    out.append((domain, r.txn, "Conflict" if hit else "Committed"))
                yield pd.DataFrame(out, columns=["domain", "txn", "outcome"])

    return ordered.mapInPandas(run, f"domain {kind}, txn long, outcome string")


def clip(ranges: DataFrame, partitions: DataFrame) -> DataFrame:
    """Each range (txn, s, e) cut to the partitions (resolver, lo, hi) it overlaps, without repeats.

    The partition map is a routing table of a few rows; it is broadcast by Spark if its size allows it.
    """
    met = ranges.join(partitions, (F.col("s") < F.col("hi")) & (F.col("lo") < F.col("e")))
    return met.select("txn", "resolver", F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e")).distinct()


def decisions(clipped: DataFrame, writes: DataFrame) -> DataFrame:
    """(txn, accepted): every resolver touched must accept.

    ``clipped`` is (txn, resolver, s, e, read_version, commit_version) over integer keys, ``writes`` (k, v).
    """
    reads = clipped.select("txn", "resolver", "read_version", F.col("commit_version").alias("at"), F.explode(F.sequence("s", F.col("e") - 1)).alias("k"))
    seen = last_write_before(reads, writes)
    each = seen.groupBy("txn", "resolver").agg((~F.coalesce(F.bool_or(F.col("wrote_at") > F.col("read_version")), F.lit(False))).alias("accepts"))
    return each.groupBy("txn").agg(F.bool_and("accepts").alias("accepted"))


def chain_problems(log: DataFrame) -> DataFrame:
    """Versions (version, envelope, previous_chain) whose chain is not the SHA-256 of the envelope before."""
    rows = with_previous(log.withColumn("own", F.sha2("envelope", 256)), "version", ["own"])
    return rows.where(F.col("previous.own") != F.col("previous_chain")).select("version")


def gaps(log: DataFrame, order: str = "version") -> DataFrame:
    """(version, missing): versions that don't follow the one before directly, and how many lack."""
    rows = with_previous(log.select(order).distinct(), order, [order])
    return rows.where(F.col(order) > F.col(f"previous.{order}") + 1).select(order, (F.col(order) - F.col(f"previous.{order}") - 1).alias("missing"))


def feed(log: DataFrame, after: int, through: int) -> DataFrame:
    """The committed suffix (after, through]; raises unless it is there up to ``through`` exactly."""
    out = log.where((F.col("version") > after) & (F.col("version") <= through))
    if after >= through or out.agg(F.max("version")).first()[0] != through:
        raise ValueError(f"the log has no suffix ({after}, {through}]")
    return out


def quorum_recover(frames: DataFrame, quorum: int) -> DataFrame:
    """(idx, digest) of the prefix that a quorum of replicas (replica, idx, digest) holds from index 0 on.

    The prefix ends at the first index without a quorum. Two quorums for one index, or a quorum beyond the
    prefix's end after a gap, are told by ``quorum_problems``.
    """
    accepted = _accepted(frames, quorum)
    first_gap = with_previous(accepted.select("idx").distinct(), "idx", ["idx"]).where(F.col("idx") != F.coalesce(F.col("previous.idx") + 1, F.lit(0))).agg(F.min("idx").alias("gap"))
    return accepted.join(F.broadcast(first_gap)).where("gap is null or idx < gap").select("idx", "digest")


def _accepted(frames: DataFrame, quorum: int) -> DataFrame:
    return frames.select("replica", "idx", "digest").distinct().groupBy("idx", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= quorum).select("idx", "digest")


def quorum_problems(frames: DataFrame, quorum: int) -> DataFrame:
    """(idx, problem): conflict for two quorums, gap for a quorum after an index without one."""
    accepted = _accepted(frames, quorum)
    conflict = accepted.groupBy("idx").count().where("count > 1").select("idx", F.lit("conflict").alias("problem"))
    jump = with_previous(accepted.select("idx").distinct(), "idx", ["idx"]).where(F.col("idx") != F.coalesce(F.col("previous.idx") + 1, F.lit(0))).select("idx", F.lit("gap").alias("problem"))
    return conflict.unionByName(jump)


def staged_prefix(held: DataFrame, log_sets: DataFrame, quorum: int) -> DataFrame:
    """(idx) of the longest prefix that every log set holds at quorum.

    ``held`` is (idx, log_set, node), ``log_sets`` names the sets; the first index short of a quorum in any set ends it.
    """
    counts = held.distinct().groupBy("idx", "log_set").agg(F.count("*").alias("n"))
    each = held.select("idx").distinct().crossJoin(F.broadcast(log_sets)).join(counts, ["idx", "log_set"], "left")
    sound = each.groupBy("idx").agg(F.bool_and(F.coalesce(F.col("n"), F.lit(0)) >= quorum).alias("ok"))
    return running(sound, "idx", "bad", F.min, F.when(~F.col("ok"), F.col("idx"))).where("bad is null").select("idx")


def ticket_problems(links: DataFrame) -> DataFrame:
    """Links (previous_ticket, ticket, arrival) that don't continue the chain, in ticket order."""
    rows = with_previous(links, "ticket", ["ticket"])
    return rows.where(F.col("previous.ticket") != F.col("previous_ticket")).select("ticket", "previous_ticket")


def pending_depth(links: DataFrame) -> DataFrame:
    """One row: the most links that ever waited for an earlier one, given arrival and ticket order."""
    ranked = with_previous(links.select("ticket", "arrival"), "ticket", ["arrival"])
    # a link is done when it and all before it in the chain have arrived
    done = running(ranked, "ticket", "done_at", F.max, F.col("arrival"))
    came = done.groupBy(F.col("arrival").alias("t")).agg(F.count("*").alias("n"))
    went = done.groupBy(F.col("done_at").alias("t")).agg((-F.count("*")).alias("n"))
    steps = came.unionByName(went).groupBy("t").agg(F.sum("n").alias("n"))
    waiting = F.sum("n").over(Window.orderBy("t"))
    return steps.select(waiting.alias("w")).agg(F.max("w").alias("depth"))


def read_dependency_problems(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(txn, k) of committed reads that a committed write in between should have changed; empty if serialisable."""
    seen = last_write_before(reads.withColumn("at", F.col("commit_version")).select("k", "at", "txn", "read_version"), writes)
    return seen.where(F.col("wrote_at") > F.col("read_version")).select("txn", "k").distinct()


def real_time_problems(history: DataFrame) -> DataFrame:
    """Rounds of (round, seq) with a sequence not above all of earlier rounds: one running maximum, not all pairs."""
    rounds = history.groupBy("round").agg(F.min("seq").alias("least"), F.max("seq").alias("most"))
    return running(rounds, "round", "above", F.max, F.col("most"), before=True).where("least <= above").select("round")


def distinct_signers(votes: DataFrame, quorum: int) -> DataFrame:
    """(item, signers, reached): repeated votes of one signer count once."""
    return votes.groupBy("item").agg(F.count_distinct("signer").alias("signers")).withColumn("reached", F.col("signers") >= quorum)


def admits(samples: DataFrame, frame_bytes: int, soft_limit: int, quorum: int) -> DataFrame:
    """One row: whether in every log set a quorum of nodes has room for a frame; RateLimited otherwise."""
    fits = F.count_if(F.col("retained") + frame_bytes <= soft_limit)
    return samples.groupBy("log_set").agg((fits >= quorum).alias("ok")).agg(F.when(F.bool_and("ok"), "Admit").otherwise("RateLimited").alias("decision"))


def history_digest(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """SHA-256 over each group's texts in order; groups are expected to be small, such as a batch."""
    items = F.sort_array(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(items, lambda x: x[text]), "\n"), 256).alias("digest"))


def causal_reads(commits: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, read_version, status) of requests (request, step, minimum) after commits (step, commit_version).

    A request reads at the newest version committed up to its step, 0 without one; it is Behind, and has to
    try again, where that is below the minimum that its client has seen.
    """
    marks = commits.select((F.col("step") * 2).alias("_at"), "commit_version", F.lit(None).cast("long").alias("request"), F.lit(None).cast("long").alias("minimum"))
    asks = requests.select((F.col("step") * 2 + 1).alias("_at"), F.lit(None).cast("long").alias("commit_version"), "request", "minimum")
    read = running(marks.unionByName(asks), "_at", "newest", F.max, F.col("commit_version")).where("request is not null")
    version = F.coalesce("newest", F.lit(0))
    return read.select("request", version.alias("read_version"), F.when(version >= F.col("minimum"), "Ok").otherwise("Behind").alias("status"))
