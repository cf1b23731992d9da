"""One decision per hit, in time order: sliding-window limits, last-seen times, one running job per key.

Over a finished log a key is not one task. Its hits fall into pieces wherever it was quiet for as long as a decision looks back, and
a piece into chunks of so many hits; a round decides one chunk of every piece, from the times the chunk before handed on.

Over a stream a key's state is the times that still count. A timer of event time ends it once the watermark has passed the last of
them by the window, so a key that stays away holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from readlake.operators import ranking
from readlake.session import pinned

# Fixed values: (hits allowed, window in seconds) of each limiter.
LIMITS = {"upload": (30, 3600), "translate_minute": (20, 60), "translate_day": (300, 86400), "search": (20, 3600), "check": (200, 3600)}
SEEN_GAP, JOB_TTL = 3600, 900
DECIDED = "key STRING, hit_id BIGINT, passed BOOLEAN"
#: Where the state of streams is kept; timers need it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
Decide = Callable[[list, float], tuple[bool, list]]


def allowed(times: list[float], now: float, limit: int, window: float) -> tuple[bool, list[float]]:
    """Whether a hit passes, and the times that count afterwards; a refused hit is not recorded."""
    live = [t for t in times if now - t < window]
    return (True, [*live, now]) if len(live) < limit else (False, live)


def spaced_out(times: list[float], now: float, gap: float) -> tuple[bool, list[float]]:
    """Whether a hit comes `gap` seconds or more after the last that passed; only that one counts."""
    passed = not times or now - times[-1] >= gap
    return passed, [now] if passed else times


# ---- a finished log


def pieces(hits: DataFrame, reach: float, most: int) -> DataFrame:
    """(key, piece, chunk, at, hit_id): hits numbered along the quiet gaps of their key, and along `most` hits inside a piece. Both
    count slice by slice of time, so a busy key is never in one task."""
    rows = hits.select("key", "at", "hit_id")
    slices = F.floor(F.col("at") / F.lit(float(max(reach, 1.0))))
    rows = ranking.with_previous(rows, ["key"], slices, ["at", "hit_id"], ["at"])
    opens = (F.col("_first") | (F.col("at") - F.col("_prev_at") >= reach)).cast("bigint")
    rows = rows.withColumn("_opens", F.coalesce(opens, F.lit(1))).drop("_first", "_prev_at")
    rows = ranking.running(rows, ["key"], slices, ["at", "hit_id"], {"piece": F.col("_opens")}).drop("_opens")
    rows = ranking.numbered(rows, ["key", "piece"], slices, ["at", "hit_id"], "n")
    return rows.select("key", "piece", F.floor((F.col("n") - 1) / most).alias("chunk"), "at", "hit_id")


def _pass(decide: Decide):
    """Sorted rows of (key, piece), each piece's carried times first, to decisions and the times left after."""
    names = ["key", "piece", "hit_id", "passed", "times"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_piece, times = None, []
        for batch in batches:
            out = []
            for key, piece, at, hit_id, carried in zip(batch["key"], batch["piece"], batch["at"], batch["hit_id"], batch["times"], strict=True):
                if (key, piece) != at_piece:
                    if at_piece is not None:
                        out.append((*at_piece, None, None, times))
                    at_piece, times = (key, piece), []
                if carried is not None:
                    times = list(carried)
                    continue
                passed, times = decide(times, at)
                out.append((key, piece, hit_id, passed, None))
            yield pd.DataFrame(out, columns=names).astype({"hit_id": "Int64", "passed": "boolean"})
        if at_piece is not None:
            yield pd.DataFrame([(*at_piece, None, None, times)], columns=names).astype({"hit_id": "Int64", "passed": "boolean"})

    return run


def decided(hits: DataFrame, decide: Decide, reach: float, most: int = 100_000) -> DataFrame:
    """(key, hit_id, passed) for every hit (key, at in seconds, hit_id), in the order of at, then hit_id. `reach`: how far back a
    decision looks. A task holds one chunk of a key at most."""
    rows = pinned(pieces(hits, reach, most), "hits")
    last = rows.agg(F.max("chunk")).first()[0]
    none = F.lit(None).cast("array<double>")
    found, carried = [], None
    for chunk in range(int(last) + 1 if last is not None else 0):
        now = rows.filter(F.col("chunk") == chunk).select("key", "piece", "at", "hit_id", none.alias("times"))
        if carried is not None:
            now = now.unionByName(carried)
        ordered = now.withColumn("_late", F.col("times").isNull()).repartition("key", "piece").sortWithinPartitions("key", "piece", "_late", "at", "hit_id").drop("_late")
        done = pinned(ordered.mapInPandas(_pass(decide), "key STRING, piece BIGINT, hit_id BIGINT, passed BOOLEAN, times ARRAY<DOUBLE>"), "decided")
        found.append(done.filter("passed is not null").select("key", "hit_id", "passed"))
        # Only pieces with hits left hand their times on.
        left = rows.filter(F.col("chunk") == chunk + 1).select("key", "piece").distinct()
        state = done.filter("times is not null").join(left, ["key", "piece"], "left_semi")
        carried = state.select("key", "piece", F.lit(None).cast("double").alias("at"), F.lit(None).cast("bigint").alias("hit_id"), "times")
    if not found:
        return hits.select(F.col("key").cast("string").alias("key"), "hit_id", F.lit(True).alias("passed")).limit(0)
    return reduce(DataFrame.unionByName, found)


def rate_limited_batch(hits: DataFrame, limit: int, window: float, most: int = 100_000) -> DataFrame:
    """At most `limit` hits that passed in any `window` seconds of a key."""
    return decided(hits, lambda times, at: allowed(times, at, limit, window), window, most)


def spaced_batch(hits: DataFrame, gap: float, most: int = 100_000) -> DataFrame:
    """Hits at least `gap` seconds after the last one that passed: a last-seen time refreshed at most once an hour, or one running
    job per key within its time to live."""
    return decided(hits, lambda times, at: spaced_out(times, at, gap), gap, most)


# ---- a stream


class _Judge(StatefulProcessor):
    """The times of a key that still count, ended by a timer."""

    def __init__(self, decide: Decide, reach: float):
        self.decide, self.reach = decide, reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times ARRAY<DOUBLE>, ends BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.times.get() if self.times.exists() else None
        times, ends = (list(held[0]), held[1]) if held else ([], None)
        now = pd.concat([r[["at", "hit_id"]] for r in rows]).sort_values(["at", "hit_id"])
        out = []
        for at, hit_id in zip(now["at"], now["hit_id"], strict=True):
            passed, times = self.decide(times, at)
            out.append((key[0], hit_id, passed))
        if times:
            new = int((max(times) + self.reach) * 1000) + 1
            if new != ends:
                if ends is not None:
                    self.handle.deleteTimer(ends)
                self.handle.registerTimer(new)
            self.times.update((times, new))
        yield pd.DataFrame(out, columns=["key", "hit_id", "passed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"key": pd.Series(dtype="str"), "hit_id": pd.Series(dtype="int64"), "passed": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def _judged(hits: DataFrame, decide: Decide, reach: float, late: str) -> DataFrame:
    hits.sparkSession.conf.set(*STORE)
    timed = hits.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint"))).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(_Judge(decide, reach), DECIDED, "append", "eventTime")


def rate_limited(hits: DataFrame, limit: int, window: float, late: str = "1 day") -> DataFrame:
    """A stream of (key, at seconds, hit_id) → (key, hit_id, passed). Hits are put in order within each micro-batch and judged as they
    arrive across batches; those later than `late` are dropped. A key's hits of one micro-batch share a task, which
    `maxFilesPerTrigger` bounds."""
    return _judged(hits, lambda times, at: allowed(times, at, limit, window), window, late)


def spaced(hits: DataFrame, gap: float, late: str = "1 day") -> DataFrame:
    """The spacing of hits over a stream: the state of a key is one time."""
    return _judged(hits, lambda times, at: spaced_out(times, at, gap), gap, late)
