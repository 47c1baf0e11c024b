"""What a snapshot may be read from: a base with a watermark per partition, and a change tail.

A manifest is one JSON file, swapped by rename. That is atomic on a local or HDFS-like file system; on an
object store a conditional put has to take its place. Readers use the file lists in it and never a
directory listing, so a DataFrame built on one manifest does not see the next.
"""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from .schemas import BASE_V1, TAIL_V2


class SnapshotUnavailable(Exception):
    """The target version is not between every watermark and what the tail holds."""


class VersionExpired(SnapshotUnavailable):
    """The target version is below the retained floor."""


@dataclass(frozen=True)
class Segment:
    """Changes in (after, through], with the digest chain that ties segments together."""

    after: int
    through: int
    path: str
    prior_chain: str = ""
    chain: str = ""


@dataclass(frozen=True)
class Manifest:
    watermarks: dict[str, int]
    available: int
    floor: int = 0
    base_files: list[str] = field(default_factory=list)
    segments: list[Segment] = field(default_factory=list)
    epoch: int = 0

    def check(self, target: int) -> int:
        """The lower bound of the tail for ``target``: the least watermark. Future is told before expired."""
        if not self.watermarks:
            raise SnapshotUnavailable("no watermarks")
        if target > self.available:
            raise SnapshotUnavailable(f"version {target} is ahead of {self.available}")
        if target < self.floor:
            raise VersionExpired(f"version {target} is below {self.floor}")
        if target < max(self.watermarks.values()):
            raise SnapshotUnavailable(f"version {target} is behind a watermark")
        return min(self.watermarks.values())

    def needed(self, target: int) -> list[Segment]:
        """The segments that reach into (least watermark, target], in order; a gap is an error."""
        lower = self.check(target)
        found = sorted((s for s in self.segments if s.through > lower and s.after < target), key=lambda s: s.after)
        reached = lower
        for segment in found:
            if segment.after > reached:
                raise SnapshotUnavailable(f"no segment covers ({reached}, {segment.after}]")
            reached = max(reached, segment.through)
        if reached < target:
            raise SnapshotUnavailable(f"no segment covers ({reached}, {target}]")
        return found

    def retain_from(self, floor: int) -> Manifest:
        """This manifest with its floor advanced; ``store`` with the epoch read makes it visible. Never beyond what is available, never back."""
        if floor > self.available:
            raise ValueError(f"version {floor} is ahead of {self.available}")
        if floor < self.floor:
            raise ValueError(f"the floor is {self.floor} already")
        return replace(self, floor=floor)

    def base(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(BASE_V1).parquet(*self.base_files)

    def tail(self, spark: SparkSession, target: int) -> DataFrame:
        paths = [s.path for s in self.needed(target)]
        return spark.read.schema(TAIL_V2).parquet(*paths) if paths else spark.createDataFrame([], TAIL_V2)


def load(path: str) -> Manifest:
    with open(path) as file:
        raw = json.load(file)
    return Manifest(**raw | {"segments": [Segment(**s) for s in raw["segments"]]})


def store(manifest: Manifest, path: str, expected_epoch: int | None = None) -> Manifest:
    """Swap the manifest at ``path`` in; refuses if another epoch than expected is there."""
    if expected_epoch is not None and (load(path).epoch if os.path.exists(path) else 0) != expected_epoch:
        raise RuntimeError("another manifest was stored meanwhile")
    out = replace(manifest, epoch=manifest.epoch + 1)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w") as file:
        json.dump(asdict(out), file)
    os.replace(temporary, path)
    return out
