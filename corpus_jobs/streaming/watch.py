"""File events as streams: which files matter, debouncing, and keeping tables fresh.

A file stream of Spark sees new paths only; changes and deletions come as rows (path, kind, ts) of an event stream.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalog import without
from ..sources.files import file_type
from ..storage import materialize

DEBOUNCE_SECONDS = 2.0
#: Events of a part of a table, for debounced_batch.
PART_EVENTS = 2_000_000
#: Event time after which a path's last event is forgotten, and how late an event may come; far longer than the debounce.
STATE_SECONDS = 3600


def watched(events: DataFrame) -> DataFrame:
    """Events of visible files with a known extension."""
    name = F.substring_index("path", "/", -1)
    return events.filter(~name.startswith(".") & file_type(name).isNotNull())


def accepted(times: list[float], last: float | None, seconds: float) -> list[bool]:
    """Which of the times, in order, come at least so many seconds after the last accepted one."""
    out = []
    for t in times:
        ok = last is None or t - last >= seconds
        out.append(ok)
        last = t if ok else last
    return out


def debounced(events: DataFrame, seconds: float = DEBOUNCE_SECONDS, keep_state: int = STATE_SECONDS) -> DataFrame:
    """A stream of events (path, kind, ts) without those that follow the path's last accepted event too soon.

    State is one time per path, kept until the watermark has passed it by keep_state seconds. A batch's rows of a path
    are gathered and sorted before the fold.
    """

    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        micros = rows["ts"].astype("int64") if rows["ts"].dtype.kind == "i" else rows["ts"].astype("datetime64[us]").astype("int64")
        last = state.get[0] if state.exists else None
        keep = accepted([t / 1e6 for t in micros], None if last is None else last / 1e6, seconds)
        kept = micros[keep]
        if len(kept):
            state.update((int(kept.iloc[-1]),))
        if state.exists:
            state.setTimeoutTimestamp(max(state.get[0] // 1000, state.getCurrentWatermarkMs()) + int(keep_state * 1000))
        yield rows[keep][["path", "kind", "ts"]]

    marked = events.select("path", "kind", "ts").withWatermark("ts", f"{keep_state} seconds")
    return marked.groupBy("path").applyInPandasWithState(fold, "path string, kind string, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


#: How late an event may come to be put in its place, for debounced_in_order.
LATE_SECONDS = 10
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _InOrder(StatefulProcessor):
    """For a path: the events that may still be overtaken, and the last accepted time. An event is judged when the watermark
    has passed it, in the order of times; once no event is left and the last accepted one is old, all is forgotten."""

    def __init__(self, seconds: float, keep: float):
        self.gap, self.keep = int(seconds * 1e6), int(keep * 1e6)

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType())]))
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("us", T.LongType()), T.StructField("kind", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues):
        new = [(us, kind) for frame in rows for us, kind in zip(frame["us"].tolist(), frame["kind"].tolist())]
        yield from self._judge(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._judge(key, [], timerValues.getCurrentWatermarkInMs())

    def _judge(self, key, new, watermark: int):
        due, rest = [], []
        for us, kind in [*self.waiting.get(), *new]:
            (due if us // 1000 < watermark else rest).append((us, kind))
        had = self.last.get()[0] if self.last.exists() else None
        last, out = had, []
        for us, kind in sorted(due, key=lambda x: (x[0], x[1] or "")):
            if last is None or us - last >= self.gap:
                out.append((us, kind))
                last = us
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(us for us, _ in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        if last is not None and (rest or (last + self.keep) // 1000 >= watermark):
            if last != had:
                self.last.update((last,))
            if not rest:
                self.handle.registerTimer((last + self.keep) // 1000 + 1)
        elif had is not None:
            self.last.clear()
        if out:
            yield pd.DataFrame({"path": [key[0]] * len(out), "kind": [k for _, k in out], "us": [us for us, _ in out]})

    def close(self) -> None:
        pass


def debounced_in_order(events: DataFrame, seconds: float = DEBOUNCE_SECONDS, late: float = LATE_SECONDS, keep: float | None = None) -> DataFrame:
    """debounced, but with events of a path judged in the order of their times, whatever batches they come in: the rows are
    those of one batch over all events, unless an event comes more than `late` seconds after a later one (such an event is
    dropped). An event is given out when the watermark has passed it. Two times `seconds`, or `keep`, after a path's last
    accepted event its state is gone. State is in RocksDB, which the session must name as its state store (ROCKSDB); a path's
    waiting events are those of the last `late` seconds."""
    marked = events.select("path", "kind", "ts").withWatermark("ts", f"{int(late * 1000)} milliseconds").withColumn("us", F.unix_micros("ts"))
    kept = marked.groupBy("path").transformWithStateInPandas(_InOrder(seconds, 2 * seconds if keep is None else keep), "path string, kind string, us long", "Append", "EventTime")
    return kept.select("path", "kind", F.timestamp_micros("us").alias("ts"))


def chains(times, seconds: int) -> list[tuple[int, int]]:
    """What the last accepted time before these times (in order, microseconds) makes of the last accepted one among them.

    (bound, last) in order: a time before them up to bound leads to last; a later one lets none of them be accepted.
    Chains that accept the same event are one from there on, so there are at most as many as times in the first interval.
    """
    open_, first, entered = deque(), None, None
    for t in times:
        first = t if first is None else first
        merged = []
        while open_ and t - open_[0][0] >= seconds:
            merged += open_.popleft()[1]
        bound = min(t - seconds, first)  # what came before is not later than the first
        if entered is None or bound > entered:
            merged.append(bound)
            entered = bound
        if merged:
            open_.append((t, merged))
    return sorted((b, last) for last, bounds in open_ for b in bounds)


def debounced_batch(events: DataFrame, seconds: float = DEBOUNCE_SECONDS, key: str = "path", micros: str = "us", buckets: int | None = None) -> DataFrame:
    """The same over a whole table events(key, us, ...), us being microseconds.

    Events are range-partitioned by key and time, so that a key with many events is many parts. Only the first key of a
    part can go on from the part before; each part says what any last accepted time would become there (chains), and
    following the parts in order gives the one that each begins with. Then every part folds its own rows in order.
    """
    gap = int(seconds * 1e6)
    rows = events.select(key, micros, "event_id")
    buckets = buckets or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_EVENTS)
    # written once, so that both passes see the same parts
    dealt = materialize(rows.repartitionByRange(buckets, key, micros, "event_id").withColumn("_part", F.spark_partition_id()), "dealt")
    order = dealt.repartitionByRange(buckets, "_part").sortWithinPartitions("_part", key, micros, "event_id")
    carried: dict[int, int] = {}

    def parts(batches):
        """(part, key, time or None) in order."""
        for b in batches:
            yield from zip(*[b.column(c).to_pylist() for c in ("_part", key, micros)])

    def summary(batches):
        for part, mine in groupby(parts(batches), lambda r: r[0]):
            for n, (k, times) in enumerate(groupby(mine, lambda r: r[1])):
                known = (t for _, _, t in times if t is not None)
                if n == 0:
                    first, found = k, chains(known, gap)
                    last = found[0][1] if found else None
                else:
                    last = None
                    for t in known:
                        last = t if last is None or t - last >= gap else last
            out = {"_part": [part], "first": [first], "bounds": [[b for b, _ in found]], "lasts": [[x for _, x in found]], "end": [k], "last": [last], "one": [n == 0]}
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("_part", pa.int32()), ("first", kind), ("bounds", pa.list_(pa.int64())), ("lasts", pa.list_(pa.int64())), ("end", kind), ("last", pa.int64()), ("one", pa.bool_())]))

    def fold(batches):
        at, last = None, None
        for b in batches:
            keep = []
            for part, k, t in parts([b]):
                if at is None or at != (part, k):
                    last = carried.get(part) if at is None or at[0] != part else None
                    at = (part, k)
                ok = t is None or last is None or t - last >= gap
                last = t if ok and t is not None else last
                keep.append(ok)
            yield b.select([key, micros, "event_id"]).filter(pa.array(keep, pa.bool_()))

    kind = to_arrow_type(dealt.schema[key].dataType)
    name = dealt.schema[key].dataType.simpleString()
    told = materialize(order.mapInArrow(summary, f"_part int, first {name}, bounds array<long>, lasts array<long>, end {name}, last long, one boolean"), "chains")
    before = None  # key and last accepted time at the end of the part before
    for r in told.orderBy("_part").toLocalIterator():  # one row per part
        last = r["last"]
        if before is not None and before[0] == r["first"] and before[1] is not None:
            carried[r["_part"]] = before[1]
            if r["one"]:
                i = bisect_left(r["bounds"], before[1])
                last = r["lasts"][i] if i < len(r["bounds"]) else before[1]
        before = (r["end"], last)
    return order.mapInArrow(fold, dealt.select(key, micros, "event_id").schema)


def deletions(events: DataFrame) -> DataFrame:
    """Delete events; these are never debounced."""
    return events.filter("kind = 'deleted'")


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the visible files of known types that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return watched(spark.readStream.format("binaryFile").schema(schema).load(folder))


def keep_fresh(events: DataFrame, catalog: Callable[[], DataFrame], tables: Callable[[], dict[str, tuple[DataFrame, str]]], reindex: Callable[[DataFrame, int], None], replace: Callable[[dict[str, DataFrame], int], None], checkpoint: str, seconds: float = DEBOUNCE_SECONDS, trigger: dict | None = None):
    """Starts two queries over an event stream: accepted changes go to `reindex`, and the documents of deleted paths are
    taken out of the tables, which `replace` stores. Both are given the batch's number, so that a repeated batch can be
    recognised. Returns the queries."""
    seen = watched(events)
    trigger = trigger or {"processingTime": f"{DEBOUNCE_SECONDS} seconds"}

    def remove(batch: DataFrame, number: int) -> None:
        gone = catalog().join(batch.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
        replace(without(gone, **tables()), number)

    changed = debounced(seen.filter("kind <> 'deleted'"), seconds).writeStream.foreachBatch(reindex).option("checkpointLocation", f"{checkpoint}/changes").trigger(**trigger).start()
    gone = deletions(seen).writeStream.foreachBatch(remove).option("checkpointLocation", f"{checkpoint}/deletions").trigger(**trigger).start()
    return changed, gone
