"""The change tail as a stream: the newest effect per id, and upkeep of a materialised base."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.snapshot import latest_effects
from ..sources.schemas import TAIL_V2

_EFFECT = "id long, commit_version long, operation string, status string, part string, amount_cents long, priority int"


def read(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Segments of a tail as they appear in a folder."""
    return spark.readStream.schema(TAIL_V2).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def newest(stream: DataFrame, through: int) -> DataFrame:
    """Emits an id's effect whenever a newer one arrives; replays and late older ones change nothing.

    State is one effect per id, so it grows with ids and not with changes. Effects after ``through`` are not seen.
    """
    names = [x.split()[0] for x in _EFFECT.split(", ")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = None
        for rows in batches:
            row = rows.loc[rows["commit_version"].idxmax()]
            if (held is None or row["commit_version"] > held[0]) and (best is None or row["commit_version"] > best["commit_version"]):
                best = row
        if best is not None:
            state.update((int(best["commit_version"]),))
            yield pd.DataFrame([[best[n] for n in names]], columns=names)

    effects = stream.where(stream["commit_version"] <= through).select(*names)
    return effects.groupBy("id").applyInPandasWithState(update, _EFFECT, "commit_version long", "append", GroupStateTimeout.NoTimeout)


def newest_in_batch(effects: DataFrame) -> DataFrame:
    """What the stream's emissions come to: the newest per id."""
    return latest_effects(effects)


def merge_batches(stream: DataFrame, target: str, checkpoint: str):
    """Upsert each micro-batch into a Parquet folder per generation, guarded by version.

    Batch n reads generation n - 1 and writes generation n whole, so a batch that is run again after a failure
    writes the same files. Returns the started query.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest_effects(batch)
        if number > 0:
            new = latest_effects(spark.read.schema(new.schema).parquet(f"{target}/generation={number - 1}").unionByName(new).dropDuplicates(["id", "commit_version"]))
        new.write.mode("overwrite").parquet(f"{target}/generation={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
