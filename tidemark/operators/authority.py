"""The publication authority: leases, roots and collections as a fold over an action log.

Actions of a range are ordered and few; ranges are independent, so each is folded on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = "range_id {kind}, step long, status string, floor long, epoch long"


class Authority:
    """State of one range: the readable floor, the frontier, the root, leases and a prepared collection."""

    def __init__(self) -> None:
        self.floor = self.frontier = self.collected = self.epoch = 0
        self.root: str | None = None
        self.pins: set[str] = set()
        self.leases: dict[str, tuple[int, int]] = {}
        self.prepared: tuple[int, int] | None = None

    def apply(self, action: str, name: str | None, value: int | None, other: int | None) -> str:
        return getattr(self, f"_{action}", lambda *_: "UnknownAction")(name, value, other)

    def _advance(self, _, frontier: int, __) -> str:
        if frontier < self.frontier:
            return "FrontierBehind"
        self.frontier = frontier
        return "Ok"

    def _acquire(self, lease: str, snapshot: int, deadline: int) -> str:
        if lease in self.leases:
            return "Ok" if self.leases[lease] == (snapshot, deadline) else "LeaseConflict"
        if snapshot < self.floor:
            return "BelowFloor"
        if snapshot > self.frontier:
            return "AheadOfFrontier"
        self.leases[lease] = (snapshot, deadline)
        self.epoch += 1
        return "Ok"

    def _renew(self, lease: str, _, deadline: int) -> str:
        if lease not in self.leases:
            return "NoLease"
        if deadline < self.leases[lease][1]:
            return "DeadlineBehind"
        self.leases[lease] = (self.leases[lease][0], deadline)
        self.epoch += 1
        return "Ok"

    def _release(self, lease: str, _, __) -> str:
        if self.leases.pop(lease, None) is None:
            return "NoLease"
        self.epoch += 1
        return "Ok"

    def _expire(self, _, tick: int, __) -> str:
        gone = [k for k, (_, deadline) in self.leases.items() if deadline <= tick]
        for lease in gone:
            del self.leases[lease]
        self.epoch += bool(gone)
        return f"Expired{len(gone)}"

    def _retain(self, _, window: int, __) -> str:
        policy = max(0, self.frontier - window)
        held = min((snapshot for snapshot, _ in self.leases.values()), default=policy)
        self.floor = max(self.floor, min(policy, held))
        return "Ok"

    def _prepare(self, _, floor: int, epoch: int) -> str:
        if epoch != self.epoch:
            return "StaleEpoch"
        if not self.collected < floor <= self.floor:
            return "FloorOutside"
        self.prepared = (floor, self.epoch)
        return "Ok"

    def _publish(self, root: str, _, epoch: int) -> str:
        if self.prepared is None:
            return "NothingPrepared"
        if epoch != self.epoch or self.prepared[1] != self.epoch:
            return "StaleEpoch"
        self.collected, self.root, self.prepared = self.prepared[0], root, None
        self.epoch += 1
        return "Ok"

    def _abandon(self, _, __, ___) -> str:
        if self.prepared is None:
            return "NothingPrepared"
        self.prepared = None
        return "Ok"

    def _pin(self, name: str, _, __) -> str:
        self.epoch += name not in self.pins
        self.pins.add(name)
        return "Ok"

    def _unpin(self, name: str, _, __) -> str:
        if name not in self.pins:
            return "NoPin"
        self.pins.remove(name)
        self.epoch += 1
        return "Ok"


def fold(actions: DataFrame) -> DataFrame:
    """(range_id, step, status, floor, epoch) after each of actions (range_id, step, action, name, value, other)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        range_id, state = None, Authority()
        for rows in batches:
            out = []
            for r in rows.astype(object).where(rows.notna(), None).itertuples():
                if r.range_id != range_id:
                    range_id, state = r.range_id, Authority()
                status = state.apply(r.action, r.name, r.value, r.other)
                out.append((r.range_id, r.step, status, state.floor, state.epoch))
            yield pd.DataFrame(out, columns=["range_id", "step", "status", "floor", "epoch"])

    kind = actions.schema["range_id"].dataType.simpleString()
    return actions.repartition("range_id").sortWithinPartitions("range_id", "step").mapInPandas(run, COLUMNS.format(kind=kind))
