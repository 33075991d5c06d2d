"""A work queue as a stateful stream: leases, cool-downs, retries and skips of each item.

An item is pending, processing, done or discarded.  ``queued`` adds an item that is
not there and leaves one that is as it was; ``claim`` takes a pending item that has
not failed too often or a short time ago; ``done``, ``failed`` and ``postponed``
end a claim.  A claim that is not ended within its lease lapses: the item is pending
again, though the worker that held it may still end it.  Too many failures or
postponements discard an item for good; one that is done is forgotten, so it may be
queued again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed

# The process that prepares the state on the driver does not look for modules where this one was found.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Steps of an item: ``event`` is null for a lapse; retries and skips as they are after the step.
STEPS = "item long, event long, at_ms long, action string, accepted boolean, status string, retries int, skips int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "status string, retries int, skips int, failed_at long, claimed_at long, last_at long, last_event long"


class Item:
    """State of one item; times in milliseconds."""

    def __init__(self, lease: int, cooldown: int, retries: int, skips: int, state: tuple | None = None) -> None:
        self.lease, self.cooldown, self.most_retries, self.most_skips = lease, cooldown, retries, skips
        self.status, self.retries, self.skips, self.failed_at, self.claimed_at, self.last_at, self.last_event = state or (None, 0, 0, None, None, None, None)

    def state(self) -> tuple:
        return self.status, self.retries, self.skips, self.failed_at, self.claimed_at, self.last_at, self.last_event

    def lapses(self, at: int) -> bool:
        """Whether the claim has lapsed before this time; the item is pending then."""
        if self.status == "processing" and at > self.claimed_at + self.lease:
            self.status = "pending"
            return True
        return False

    def step(self, at: int, action: str) -> bool:
        """Whether an action at this time is accepted."""
        if action == "queued":
            fresh = self.status is None
            if fresh:
                self.status = "pending"
            return fresh
        if self.status in (None, "discarded"):
            return False
        if action == "claim":
            cool = self.failed_at is None or at - self.failed_at >= self.cooldown
            if self.status != "pending" or not cool:
                return False
            self.status, self.claimed_at = "processing", at
            return True
        if self.claimed_at is None:
            return False
        self.claimed_at = None
        if action == "done":
            self.status = "done"
        elif action == "failed":
            self.retries, self.failed_at = self.retries + 1, at
            self.status = "discarded" if self.retries >= self.most_retries else "pending"
        else:
            self.skips += 1
            self.status = "discarded" if self.skips >= self.most_skips else "pending"
        return True


_Step = Row("item", "event", "at_ms", "action", "accepted", "status", "retries", "skips")


class _Queue(StatefulProcessor):
    def __init__(self, *limits: int) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("item", _STATE)

    def _load(self) -> Item:
        return Item(*self.limits, state=tuple(self.value.get()) if self.value.exists() else None)

    def _store(self, item: Item) -> None:
        if item.status == "done":
            self.value.clear()
        elif item.status is not None:
            self.value.update(item.state())

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        item = self._load()
        # A batch may bring an item's actions in any order; those of an earlier batch stand.
        for at, event, action in sorted((r["at_ms"], r["event"], r["action"]) for r in rows):
            if item.lapses(at):
                yield _Step(key[0], None, item.claimed_at + item.lease, "lapse", True, item.status, item.retries, item.skips)
            accepted = item.step(at, action)
            yield _Step(key[0], event, at, action, accepted, item.status, item.retries, item.skips)
            if accepted and action == "claim":
                self.handle.registerTimer(at + item.lease)
            if item.status == "done":
                item = Item(*self.limits)
                self.value.clear()
        self._store(item)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        item = self._load()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if item.status == "processing" and item.claimed_at + item.lease == due:
            item.status = "pending"
            self._store(item)
            yield _Step(key[0], None, due, "lapse", True, item.status, item.retries, item.skips)

    def close(self) -> None:
        pass


def queue_steps(
    actions: DataFrame, item: Column, event: Column, at: str, action: Column, delay: str = "10 minutes", lease: int = fixed.CLAIM_LEASE, cooldown: int = fixed.RETRY_COOLDOWN, retries: int = fixed.MOST_RETRIES, skips: int = fixed.MOST_SKIPS
) -> DataFrame:
    """STEPS of a stream of actions, with a row for each action and each lapse; at is a timestamp column, limits are seconds.

    Rows later than the watermark's delay are dropped.  Rows without item, time or action, or with another action, take no
    part.  A lapse is told by the next action of its item or, by a timer, once the watermark has passed it.  The state is one
    small row an item; an item's actions of one batch are sorted in memory.
    """
    actions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # timers need it
    known = action.isin("queued", "claim", "done", "failed", "postponed")
    rows = actions.select(item.cast("long").alias("item"), event.cast("long").alias("event"), F.col(at).cast("timestamp").alias("__at"), action.alias("action")).where(F.col("item").isNotNull() & F.col("__at").isNotNull() & known)
    rows = rows.withWatermark("__at", delay).withColumn("at_ms", F.unix_millis("__at"))
    limits = (lease * 1000, cooldown * 1000, retries, skips)
    return rows.groupBy("item").transformWithState(_Queue(*limits), STEPS, "Append", "eventTime")
