"""Streams with a state per key: alerts, review logs, first arrivals.

Each processor keeps a few values per key and gives a row when its answer
changes. What it keeps are the latest values by event order, not by arrival, so
the answers do not depend on how the rows are dealt over files and batches. The
state store has to be one that serves many keys (``use_state_store``).
"""

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from voxframe.streaming.metrics import COLLAPSE_EPOCHS, COLLAPSE_LOSS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark):
    """State on the executors' disks, saved as changes, not as whole tables."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _Collapse(StatefulProcessor):
    """First row below the level, last row not below it, and what was said."""

    STATE = "first_at long, first_step long, first_epoch int, last_at long, last_step long, collapsed boolean, alerts long, timer long"

    def __init__(self, run, epochs, idle_ms):
        self.run, self.epochs, self.idle_ms = run, epochs, idle_ms

    def init(self, handle):
        self.handle, self.state = handle, handle.getValueState("run", self.STATE)

    def handleInputRows(self, key, rows, timerValues):
        old = self.state.get() if self.state.exists() else (None,) * 6 + (0, None)
        first, last = (old[0], old[1], old[2]), (old[3], old[4])
        newest = None
        for pdf in rows:
            for at, step, epoch, below in zip(pdf["at"].tolist(), pdf["step"].tolist(), pdf["epoch"].tolist(), pdf["below"].tolist()):
                newest = at if newest is None else max(newest, at)
                if below is None:
                    continue
                if below and (first[0] is None or (at, step) < first[:2]):
                    first = (at, step, epoch)
                elif not below and (last[0] is None or (at, step) > last):
                    last = (at, step)
        stays = first[0] is not None and (last[0] is None or last < first[:2])
        collapsed = bool(stays and first[2] <= self.epochs)
        alerts = old[6] + (collapsed and not old[5])
        timer = old[7]
        if self.idle_ms is not None and newest is not None:
            due = newest // 1000 + self.idle_ms
            if timer is None or due > timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                timer = due
        self.state.update((*first, *last, collapsed, alerts, timer))
        if (old[5], old[2]) != (collapsed, first[2]):
            yield pd.DataFrame(
                {self.run: [key[0]], "first_epoch": pd.array([first[2]], "Int32"), "collapsed": [collapsed], "alerts": [alerts]}
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """A run that was quiet for long is over: its state goes, its answer stays."""
        self.state.clear()
        return iter([])


def collapse_alerts(series, run, thr=COLLAPSE_LOSS, epochs=COLLAPSE_EPOCHS, watermark=None, idle_ms=None):
    """As ``metrics.collapse_alert``, but a row whenever the answer for a run changes.

    ``alerts`` counts how often the run has turned to collapsed: 1 is the alert,
    a higher number says that later rows of an earlier time had taken it back.
    With ``watermark`` and ``idle_ms`` a run without rows for so long loses its
    state, and rows later than the watermark are left out.
    """
    kind = series.schema[run].dataType.simpleString()
    below = (F.col("loss") < thr).alias("below")
    if watermark:
        series = series.withWatermark("ts", watermark)
    rows = series.select(run, "ts", F.unix_micros("ts").alias("at"), F.col("step").cast("long").alias("step"), F.col("epoch").cast("int").alias("epoch"), below)
    return rows.groupBy(run).transformWithStateInPandas(
        _Collapse(run, epochs, idle_ms if watermark else None),
        f"`{run}` {kind}, first_epoch int, collapsed boolean, alerts long",
        "Update",
        "EventTime" if watermark else "None",
    )


class _Review(StatefulProcessor):
    """For each field of a review the latest event that sets it."""

    STATE = (
        "first_at long, first_variant string, forced_at long, forced_variant string, "
        "review_at long, reviewed boolean, notes_at long, notes string, initialized boolean"
    )

    def __init__(self, key):
        self.key = key

    def init(self, handle):
        self.state = handle.getValueState("review", self.STATE)

    def handleInputRows(self, key, rows, timerValues):
        old = self.state.get() if self.state.exists() else None
        first, forced, review, notes, init = (old[0:2], old[2:4], old[4:6], old[6:8], old[8]) if old else ((None, None),) * 4 + (False,)

        def later(held, at, value):
            return (at, value) if held[0] is None or at > held[0] else held

        for pdf in rows:
            columns = (pdf[c].tolist() for c in ("at", "kind", "variant", "force", "notes"))
            for at, kind, variant, force, note in zip(*columns):
                if kind == "init":
                    init = True
                    if first[0] is None or at < first[0]:
                        first = (at, variant)
                    if force:
                        forced, review = later(forced, at, variant), later(review, at, False)
                elif kind in ("review", "unmark"):
                    review = later(review, at, kind == "review")
                    if kind == "unmark" or note is not None:
                        notes = later(notes, at, note if kind == "review" else None)
        new = (*first, *forced, *review, *notes, init)
        self.state.update(new)
        if old is None or tuple(old) != new:
            variant = forced[1] if forced[1] is not None else first[1]
            yield pd.DataFrame(
                {self.key: [key[0]], "init_variant": [variant], "initialized": [init], "reviewed": [bool(review[1])], "review_notes": [notes[1]]}
            )


def review_states(events, key="patch_id", order="seq"):
    """As ``review.apply_review_events``, but a row whenever a patch's state changes."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, F.col(order).cast("long").alias("at"), "kind", "variant", F.coalesce("force", F.lit(False)).alias("force"), "notes")
    return rows.groupBy(key).transformWithStateInPandas(
        _Review(key), f"`{key}` {kind}, init_variant string, initialized boolean, reviewed boolean, review_notes string", "Update", "None"
    )


class _FirstSeen(StatefulProcessor):
    """Lets the first row of a key pass."""

    def init(self, handle):
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        known, first = self.seen.exists(), None
        for pdf in rows:
            first = pdf.iloc[:1] if first is None and len(pdf) else first
        if not known and first is not None:
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key, initialState, timerValues):
        self.seen.update((True,))


def first_arrivals(rows, key, known=None):
    """The first row of each key that is not in ``known``, a batch table of keys.

    ``known`` is read once, when the stream first starts; after that the state
    alone answers, so what a batch reads does not grow with what is stored.
    """
    start = known.select(key).distinct().groupBy(key) if known is not None else None
    return rows.groupBy(key).transformWithStateInPandas(_FirstSeen(), rows.schema, "Append", "None", initialState=start)
