"""Streams whose state must see rows in order of time, each with the batch form that it must equal.

A key's rows wait in its state until the watermark has passed them; then they go, in order, through a fold: a small object
with step(time, rows) that remembers what it needs and gives rows out. An event-time timer wakes a key whose rows are
due though no new ones came. The batch forms run the same question as windows and joins over the whole table.
"""

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A file's two looks at the same size and time; refusals in a row that count, and how long nothing may have got through. Fixed values of the last two: 12 and 300.
STREAK, QUIET_S = 12, 300
DAY_US = 86_400 * 1_000_000
#: Times that a fold takes before its rows are given out.
CHUNK = 20_000


def in_order(rows: DataFrame, key: str, columns: list[str], make: Callable, schema: str, at: str = "at", forget: str | None = None) -> DataFrame:
    """A fold over the rows of each key in order of `at`, then of `columns`, as a stream with a watermark on `at`.

    make() gives a new fold; step(time in microseconds, [rows at that time as tuples of columns]) gives tuples that follow the
    key in `schema`. forget: after so long without a row (an interval like "7 days"), a key's state goes.
    """
    out = [f.split()[0] for f in schema.split(", ")]
    gone = int(pd.Timedelta(forget).total_seconds() * 1000) if forget else None

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, fold, last = pickle.loads(state.get[0]) if state.exists else (None, make(), 0)
        if not state.hasTimedOut:
            new = [b[[at, *columns]].assign(**{at: b[at].astype("datetime64[us]").astype("int64")}) for b in batches if len(b)]
            pending = pd.concat([x for x in (pending, *new) if x is not None and len(x)] or new, ignore_index=True) if new else pending
        mark, ready = state.getCurrentWatermarkMs(), 0
        if pending is not None and len(pending):
            due = pending[at] // 1000 < mark
            now, pending = pending[due].sort_values([at, *columns], na_position="first", ignore_index=True), pending[~due]
            times, ready = now[at].to_numpy(), len(now)
            starts = np.flatnonzero(np.r_[True, times[1:] != times[:-1]]) if ready else times
            for some in range(0, len(starts), CHUNK):
                bounds = [*starts[some : some + CHUNK].tolist(), int(starts[some + CHUNK]) if some + CHUNK < len(starts) else ready]
                rows_ = list(zip(*(now[c].iloc[bounds[0] : bounds[-1]].tolist() for c in columns), strict=True))
                found = [(*k, *r) for a, z in zip(bounds, bounds[1:]) for r in fold.step(int(times[a]), rows_[a - bounds[0] : z - bounds[0]])]
                if found:
                    yield pd.DataFrame(found, columns=out)
            last = int(times[-1]) // 1000 if ready else last
        held = pending is not None and len(pending) > 0
        if not held and gone is not None and last + gone < mark:
            state.remove()
        else:
            state.update((pickle.dumps((pending if held else None, fold, last)),))
            wake = int(pending[at].min()) // 1000 if held else last + gone if gone is not None else None
            if wake is not None:
                state.setTimeoutTimestamp(max(wake, mark + 1))

    return rows.select(key, at, *columns).groupBy(key).applyInPandasWithState(step, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def passed(rows: DataFrame, all_rows: DataFrame, delay: str, at: str = "at") -> DataFrame:
    """Of a batch form's rows, those that a stream has given out once all_rows are in: what the last watermark has passed."""
    last = all_rows.agg((F.unix_millis(F.max(at)) - F.unix_millis(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {delay}"))).alias("_last"))
    return rows.join(F.broadcast(last), F.unix_millis(at) < F.col("_last")).drop("_last")  # one row


class Settled:
    """A file counts once its size and time were the same in two sweeps one after the other, and it isn't empty."""

    def __init__(self):
        self.before, self.done = None, False

    def step(self, time: int, rows: list[tuple]) -> list[tuple]:
        out = []
        for size, changed in rows:
            if not self.done and size and self.before == (size, changed):
                self.done = True
                out.append((size, changed, pd.Timestamp(time, unit="us")))
            self.before = (size, changed)
        return out


def settled_files(listings: DataFrame) -> DataFrame:
    """listings (path, size, changed, at: when the sweep saw it) -> (path, size, changed, at) of the first sweep that finds a file settled."""
    order = W.partitionBy("path").orderBy("at", "size", "changed")
    same = (F.col("size") > 0) & (F.col("size") == F.lag("size").over(order)) & (F.col("changed") == F.lag("changed").over(order))
    first = listings.withColumn("_s", same).filter("_s")
    return first.groupBy("path").agg(F.min_by(F.struct("size", "changed", "at"), F.struct("at", "size", "changed")).alias("x")).select("path", "x.*")


def settled_stream(listings: DataFrame) -> DataFrame:
    """settled_files() as a stream; a path that no sweep has shown for a week is forgotten."""
    return in_order(listings, "path", ["size", "changed"], Settled, "path string, size long, changed long, at timestamp", forget="7 days")


class Trailing:
    """Sums by time over the last day, in two stacks: the later ones with their sum, the earlier ones each with the sum from it on.

    An entry goes once from one to the other, so a call costs the same however many the day holds; nothing is taken off a sum, so no rounding gathers.
    """

    def __init__(self):
        self.earlier, self.later, self.sum = [], [], 0.0

    def step(self, time: int, rows: list[tuple]) -> list[tuple]:
        self.later.append((time, sum(cost for _, cost in rows)))
        self.sum += self.later[-1][1]
        while (self.earlier[-1] if self.earlier else self.later[0])[0] < time - DAY_US:
            if not self.earlier:
                upto = 0.0
                for t, s in reversed(self.later):
                    upto += s
                    self.earlier.append((t, upto))
                self.later, self.sum = [], 0.0
            self.earlier.pop()
        spent = self.sum + (self.earlier[-1][1] if self.earlier else 0.0)
        return [(call_id, pd.Timestamp(time, unit="us"), round(spent, 4) + 0.0) for call_id, _ in rows]


def trailing_stream(calls: DataFrame) -> DataFrame:
    """What each library has spent in the 24 hours up to each call, equal times included: (workspace_id, call_id, at, spent)."""
    calls = calls.withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))
    return in_order(calls, "workspace_id", ["call_id", "cost_usd"], Trailing, "workspace_id string, call_id long, at timestamp, spent double")


class Refusals:
    """Different keys refused since something last got through; told when they are `streak` and nothing has for `quiet` seconds, then counted anew."""

    def __init__(self, streak: int = STREAK, quiet: float = QUIET_S):
        self.streak, self.quiet, self.keys, self.through = streak, int(quiet * 1e6), set(), None

    def step(self, time: int, rows: list[tuple]) -> list[tuple]:
        out = []
        self.through = time if self.through is None else self.through
        for _, key, ok in rows:
            if ok:
                self.keys, self.through = set(), time
                continue
            self.keys.add(key)
            if len(self.keys) >= self.streak and time - self.through >= self.quiet:
                out.append((pd.Timestamp(time, unit="us"), len(self.keys), pd.Timestamp(self.through, unit="us")))
                self.keys = set()
        return out


def refusal_stream(calls: DataFrame, streak: int = STREAK, quiet: float = QUIET_S) -> DataFrame:
    """(workspace_id, at, keys, since): when a library is to rest."""
    return in_order(calls, "workspace_id", ["call_id", "job_id", "ok"], lambda: Refusals(streak, quiet), "workspace_id string, at timestamp, keys int, since timestamp")


def refusal_rests(calls: DataFrame, streak: int = STREAK, quiet: float = QUIET_S) -> DataFrame:
    """refusal_stream() over a whole table: each stretch without a success on its own, so that a library's calls spread over tasks.

    A stretch is what lies between two successes (before the first: from the first call on). Rests inside one depend on each other, so
    its refusals are folded in order, but only they.
    """
    from shotlake.streaming.jobs import running

    rows = running(calls, ["workspace_id"], F.coalesce(F.col("ok"), F.lit(False)).cast("int"), "stretch")
    since = rows.groupBy("workspace_id", "stretch").agg(F.min("at").alias("since"))
    refused = rows.filter(~F.coalesce("ok", F.lit(False))).join(since, ["workspace_id", "stretch"]).select("workspace_id", "stretch", "at", "call_id", "job_id", "since")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["at", "call_id"])
        rest, out = Refusals(streak, quiet), []
        rest.through = int(part["since"].astype("datetime64[us]").astype("int64").iloc[0])
        for time, call, job in zip(part["at"].astype("datetime64[us]").astype("int64").tolist(), part["call_id"], part["job_id"], strict=True):
            out += [(part["workspace_id"].iloc[0], *r) for r in rest.step(time, [(call, job, False)])]
        return pd.DataFrame(out, columns=["workspace_id", "at", "keys", "since"])

    return refused.groupBy("workspace_id", "stretch").applyInPandas(fold, "workspace_id string, at timestamp, keys int, since timestamp")


def rates(calls: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", least: int = 8) -> DataFrame:
    """(workspace_id, start, at, rate, n): share of a library's calls that went through, in windows with `least` calls; at is a window's last moment."""
    out = calls.groupBy("workspace_id", F.window("at", window, slide).alias("w")).agg(F.avg(F.coalesce("ok", F.lit(False)).cast("double")).alias("rate"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return out.select("workspace_id", F.col("w.start").alias("start"), F.window_time("w").alias("at"), F.round("rate", 6).alias("rate"), "n")


def rests(calls: DataFrame, below: float = 0.08, window: str = "30 minutes", slide: str = "10 minutes", least: int = 30) -> DataFrame:
    """Windows of half an hour in which hardly anything got through."""
    return rates(calls, window, slide, least).filter(F.col("rate") < below)


class Pace(StatefulProcessor):
    """slow below one mark, fast above the other, else as before; only changes are told. Windows come in order, since the aggregate gives each out once the watermark has closed it."""

    def __init__(self, slow: float, fast: float):
        self.slow, self.fast = slow, fast

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pace = handle.getValueState("pace", "pace string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, out = self.pace.get()[0] if self.pace.exists() else "fast", []
        for start, rate in pd.concat(list(rows)).sort_values("start")[["start", "rate"]].itertuples(index=False, name=None):
            turn = "slow" if rate < self.slow else "fast" if rate > self.fast else now
            if turn != now:
                out.append((*key, start, turn))
            now = turn
        self.pace.update((now,))
        if out:
            yield pd.DataFrame(out, columns=["workspace_id", "start", "pace"])

    def close(self) -> None:
        pass


def pace_stream(measured: DataFrame, slow: float = 0.15, fast: float = 0.30) -> DataFrame:
    """Changes of pace (workspace_id, start, pace) from rates(): state behind a windowed aggregate. Runs under rocksdb()."""
    return measured.groupBy("workspace_id").transformWithStateInPandas(Pace(slow, fast), "workspace_id string, start timestamp, pace string", "Append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which transformWithState needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pace_changes(measured: DataFrame, slow: float = 0.15, fast: float = 0.30) -> DataFrame:
    """pace_stream() over a table of rates."""
    turn: Column = F.when(F.col("rate") < slow, "slow").when(F.col("rate") > fast, "fast")
    order = W.partitionBy("workspace_id").orderBy("start")
    turns = measured.withColumn("pace", turn).filter("pace IS NOT NULL")
    turns = turns.withColumn("was", F.coalesce(F.lag("pace").over(order), F.lit("fast")))
    return turns.filter(F.col("pace") != F.col("was")).select("workspace_id", "start", "pace")
