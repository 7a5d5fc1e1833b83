"""T4: the fetcher's retry schedule as keyed streaming state.

Attempts ``(url, attempt, status, error, content_type)`` stream in, in any
order. Per URL, typed state variables (RocksDB) hold the loop's progress (next
expected attempt, backoff so far), the attempts that arrived early, and, once
the loop has ended, a marker. When an attempt ends the loop (200, a status or
error that is not retried, or the fifth attempt) the URL's outcome is emitted
once, equal to the batch operator ``frontier.fetch_outcome`` on a log without
gaps; progress and early attempts are then freed and the marker keeps repeated
and late attempts from emitting anything more.

Two options bound the state by processing time. ``keep_done_s`` lets markers
expire (an attempt that comes later than that would start its URL anew).
``stalled_after_s`` sets a time with every attempt that leaves the URL open: when it
has come, the URL is emitted as ``pending`` with the attempts it had and is then finished.

Spark deals the URLs by hash to a fixed number of buckets and keeps the state across
micro-batches and restarts: per bucket, maps keyed by URL. Python asks the JVM for state
over a socket, which costs far more than the step itself, so the URLs of a
bucket that a micro-batch holds are read together: by one pass over the
bucket's map, or one by one where the map is much longer. The step is a helper
over the few rows of one URL: attempt numbers outside 1 to 5 are ignored, and
of an attempt seen twice the smaller ``(kind, content type)`` counts within a
micro-batch and the first across them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sitegraph.operators.frontier import FIRST_DELAY_S, MAX_ATTEMPTS, attempt_class
from sitegraph.streaming.discovery import use_rocksdb_state

LOG_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("attempt", T.IntegerType()),
    T.StructField("status", T.IntegerType()), T.StructField("error", T.StringType()),
    T.StructField("content_type", T.StringType()),
])
OUT_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()), T.StructField("outcome", T.StringType()),
    T.StructField("attempts", T.LongType()), T.StructField("backoff_s", T.LongType()),
    T.StructField("content_type", T.StringType()),
])


#: URLs are dealt to so many keys of the state; a checkpoint keeps its number.
BUCKETS = 4096
#: A pass over a map reads about so many entries in the time of one lookup.
PASS_ENTRIES = 4


class RetryLoop(StatefulProcessor):
    """The retry loops of one bucket of URLs; its rows carry ``names``, ``attempt``, ``kind`` (see ``attempt_class``) and ``content_type``."""

    def __init__(self, names: Sequence[str], keep_done_s: int | None = None, stalled_after_s: int | None = None):
        self.names, self.keep_done_s, self.stalled_after_s = list(names), keep_done_s, stalled_after_s
        self.out = Row(*self.names, "outcome", "attempts", "backoff_s", "content_type")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        url = _with_keys(T.StructType(), self.names)
        tried = _with_keys(T.StructType([T.StructField("attempt", T.IntegerType())]), self.names)
        self.progress = handle.getMapState("progress", url, "next_n int, backoff long, content_type string, stalls_at long")
        self.early = handle.getMapState("early", tried, "kind string, content_type string")
        self.done = handle.getMapState("done", url, "at_attempt int", self.keep_done_s and self.keep_done_s * 1000)
        # entries of the three maps, expired markers included
        self.held = handle.getValueState("held", "progress long, early long, done long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen: dict[tuple, dict[int, tuple]] = {}
        for r in rows:
            tries = seen.setdefault(tuple(r[c] for c in self.names), {})
            n, t = r.attempt, (r.kind, r.content_type)
            if n not in tries or _order(t) < _order(tries[n]):
                tries[n] = t
        held = self.held.get() or (0, 0, 0)
        self.n_open, self.n_early, self.n_done = held
        done = self._known(self.done, self.n_done, seen)
        seen = {url: tries for url, tries in seen.items() if url not in done}
        opened = self._read(self.progress, self.n_open, seen)
        early = self._early(opened)
        stalls_at = timerValues.getCurrentProcessingTimeInMs() + self.stalled_after_s * 1000 if self.stalled_after_s else None
        left_open = False
        for url, tries in seen.items():
            was = opened.get(url)
            waiting = early.get(url, {})
            out, now = self._step(url, tries, was, waiting)
            if out:
                yield self._finish(url, was is not None, waiting, *out)
                continue
            left_open = True
            if was is None or was != (*now, stalls_at):
                self.progress.updateValue(url, (*now, stalls_at))
                self.n_open += was is None
        if left_open and stalls_at and not list(self.handle.listTimers()):
            self.handle.registerTimer(stalls_at)
        self._hold(held)

    def _step(self, url, tries, was, waiting) -> tuple[tuple | None, tuple]:
        """The outcome of a loop that ends, and the progress of one that stays open, whose early attempts are kept."""
        n, backoff, ct = was[:3] if was else (1, 0, None)
        first = n
        while True:
            step = waiting.get(n) or tries.get(n)
            if step is None:
                break
            kind, ct = step
            sleeps = kind == "retry_server" or (kind == "retry_network" and n < MAX_ATTEMPTS)
            backoff += FIRST_DELAY_S << (n - 1) if sleeps else 0
            if kind in ("ok", "fail") or n == MAX_ATTEMPTS:
                return ("ok" if kind == "ok" else "failed", n, backoff, ct), ()
            n += 1
        for later, t in tries.items():
            if later > n and later not in waiting:
                self.early.updateValue((*url, later), t)
                self.n_early += 1
        self._drop_early(url, [used for used in waiting if first < used < n])
        return None, (n, backoff, ct)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get() or (0, 0, 0)
        self.n_open, self.n_early, self.n_done = held
        now = timerValues.getCurrentProcessingTimeInMs()
        timed = {url: p for url, p in self.progress.iterator() if p[3] is not None}
        stalled = {url: p for url, p in timed.items() if p[3] <= now}
        early = self._early(stalled)
        for url, (n, backoff, ct, _) in stalled.items():
            yield self._finish(url, True, early.get(url, {}), "pending", n - 1, backoff, ct)
        if later := [p[3] for url, p in timed.items() if url not in stalled]:
            self.handle.registerTimer(min(later))
        self._hold(held)

    def _finish(self, url, opened, waiting, outcome, attempts, backoff, content_type) -> Row:
        if opened:
            self.progress.removeKey(url)
            self.n_open -= 1
        self._drop_early(url, waiting)
        self.done.updateValue(url, (attempts,))
        self.n_done += 1
        return self.out(*url, outcome, attempts, backoff, content_type)

    def _drop_early(self, url, attempts) -> None:
        for n in attempts:
            self.early.removeKey((*url, n))
            self.n_early -= 1

    def _early(self, opened) -> dict[tuple, dict[int, tuple]]:
        """Early attempts of open URLs."""
        found: dict[tuple, dict[int, tuple]] = {}
        wanted = {(*url, n) for url, p in opened.items() for n in range(p[0] + 1, MAX_ATTEMPTS + 1)}
        for (*url, n), t in self._read(self.early, self.n_early, wanted).items():
            found.setdefault(tuple(url), {})[n] = t
        return found

    @staticmethod
    def _known(state, entries: int, wanted) -> set[tuple]:
        """Which of the wanted keys a map of so many entries has."""
        if not entries or not wanted:
            return set()
        if entries > PASS_ENTRIES * len(wanted):
            return {k for k in wanted if state.containsKey(k)}
        return {k for k in state.keys() if k in wanted}

    @staticmethod
    def _read(state, entries: int, wanted) -> dict[tuple, tuple]:
        """The same with their values."""
        if not entries or not wanted:
            return {}
        if entries > PASS_ENTRIES * len(wanted):
            return {k: tuple(state.getValue(k)) for k in wanted if state.containsKey(k)}
        return {k: v for k, v in state.iterator() if k in wanted}

    def _hold(self, before) -> None:
        if (held := (self.n_open, self.n_early, self.n_done)) != tuple(before):
            self.held.update(held)

    def close(self) -> None:
        pass


def _order(t: tuple) -> tuple:
    """Nulls first, as Spark orders structs."""
    return tuple((x is not None, x or "") for x in t)


def _with_keys(schema: T.StructType, by) -> T.StructType:
    return T.StructType([*[T.StructField(c, T.StringType()) for c in by], *schema.fields])


def start_retry_stream(spark: SparkSession, log_dir: str, sink_dir: str, checkpoint: str,
                       available_now: bool = True, max_files_per_trigger: int | None = None,
                       by: Sequence[str] = (), keep_done_s: int | None = None,
                       stalled_after_s: int | None = None) -> StreamingQuery:
    """Start the outcome stream from attempt files in ``log_dir`` into ``sink_dir`` (Parquet).

    ``by`` (string columns such as ``crawl_id``) keeps the attempts of many
    crawls apart. ``keep_done_s`` and ``stalled_after_s`` (see above) need a
    stream that goes on, so they are refused with ``available_now``.
    """
    timed = bool(keep_done_s or stalled_after_s)
    if timed and available_now:
        raise ValueError("keep_done_s and stalled_after_s need available_now=False")
    use_rocksdb_state(spark)
    reader = spark.readStream.schema(_with_keys(LOG_SCHEMA, by))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    keys = [*by, "url"]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket")
    log = reader.parquet(log_dir).where(F.col("attempt").between(1, MAX_ATTEMPTS)).select(
        bucket, *keys, "attempt", attempt_class(F.col("status"), F.col("error")).alias("kind"), "content_type")
    out = log.groupBy("_bucket").transformWithState(
        RetryLoop(keys, keep_done_s, stalled_after_s), _with_keys(OUT_SCHEMA, by), "Append",
        "ProcessingTime" if timed else "None")
    writer = (out.writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
