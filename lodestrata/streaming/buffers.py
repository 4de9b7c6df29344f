"""Buffers of messages that are cut at hard limits and at gaps, in batch and, as keyed state with timers, in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A cell: its messages' first and last time (microseconds since 1970), their number, their tokens and the id of the first.
CELL = "start long, end long, n long, tokens long, first_id long"


class Limits:
    """When a buffer is cut before a message: it holds max_messages, the message would bring it over max_tokens, or comes more than gap seconds after the last one.

    A single message of more tokens is a cell of its own.
    """

    def __init__(self, max_messages: int = 50, max_tokens: int = 8192, gap: int = 1800):
        self.max_messages, self.max_tokens, self.gap = max_messages, max_tokens, gap * 1_000_000

    def cuts(self, cell: tuple | None, ts: int, tokens: int) -> bool:
        return cell is not None and (cell[2] >= self.max_messages or cell[3] + tokens > self.max_tokens or ts - cell[1] > self.gap)

    @staticmethod
    def added(cell: tuple | None, ts: int, tokens: int, message: int) -> tuple:
        return (ts, ts, 1, tokens, message) if cell is None else (cell[0], ts, cell[2] + 1, cell[3] + tokens, cell[4])


def message_cells(messages: DataFrame, limits: Limits) -> DataFrame:
    """key and the columns of a cell, of messages (key, id, ts, tokens) in the order of ts, then id; null tokens count as 0, and messages without a time are left out.

    Gaps always cut, so each stretch between gaps is folded by itself, in batches with a few numbers carried on: a task holds a batch, not a key.
    """
    rows = messages.where("ts is not null").select("key", "id", F.unix_micros("ts").alias("at"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    w = Window.partitionBy("key").orderBy("at", "id")
    far = F.coalesce(F.col("at") - F.lag("at").over(w) > limits.gap, F.lit(True))
    # a stretch is named by its first message
    begun = F.last(F.when(F.col("far"), F.struct("at", "id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = rows.withColumn("far", far).withColumn("stretch", begun).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "at", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, key, names = None, None, ["key", "start", "end", "n", "tokens", "first_id"]
        kind = None

        def batch(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), *(pa.array([d[1][c] for d in done], pa.int64()) for c in range(5))], names)

        for b in batches:
            kind, done = b.column("key").type, []
            for k, message, at, tokens, first in zip(*(b.column(c).to_pylist() for c in ("key", "id", "at", "tokens", "far")), strict=True):
                if cell is not None and (first or limits.cuts(cell, at, tokens)):
                    done.append((key, cell))
                    cell = None
                cell, key = limits.added(cell, at, tokens, message), k
            yield batch(done)
        if cell is not None:
            yield batch([(key, cell)])

    kind = messages.schema["key"].dataType.simpleString()
    return dealt.select("key", "id", "at", "tokens", "far").mapInArrow(fold, f"key {kind}, {CELL}")


class _Buffer(StatefulProcessor):
    """Messages wait until the watermark passes them, then join the key's open cell in order; the cell ends by a limit, or by a timer after the gap."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("cell", CELL)
        self.waiting = handle.getListState("waiting", "at long, id long, tokens long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for part in rows:
            for at, message, tokens in zip(part["at"], part["id"], part["tokens"], strict=True):
                self.waiting.appendValue((int(at), int(message), int(tokens)))
                times.add(int(at) // 1000 + 1)
        for ms in times:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed is here, so that one timer does the work of others before it
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [w for w in waiting if w[0] < upto], [w for w in waiting if w[0] >= upto]
        cell, done = tuple(self.cell.get()) if self.cell.exists() else None, []
        for at, message, tokens in ready:
            if self.limits.cuts(cell, at, tokens):
                done.append(cell)
                cell = None
            cell = self.limits.added(cell, at, tokens, message)
        if cell is not None and upto - cell[1] > self.limits.gap:
            done.append(cell)
            cell = None
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if cell is None:
            self.cell.clear()
        else:
            self.cell.update(cell)
            if ready:
                # the first millisecond by which more than the gap has passed
                self.handle.registerTimer((cell[1] + self.limits.gap) // 1000 + 1)
        if done:
            yield pd.DataFrame([(*key, *c) for c in done], columns=["key", "start", "end", "n", "tokens", "first_id"])

    def close(self) -> None:
        pass


def streamed_cells(messages: DataFrame, limits: Limits, delay: str = "10 minutes") -> DataFrame:
    """message_cells() of a stream: messages up to `delay` late have their place, later ones are dropped; a cell comes out when it is cut, or when the watermark is past its gap.

    A key's state is one cell of five numbers and the messages that the watermark hasn't passed; a key without messages has none. The session needs the
    RocksDB state store. Event times are compared in milliseconds by the timers and in microseconds by the limits.
    """
    kind = messages.schema["key"].dataType.simpleString()
    rows = messages.where("ts is not null").withWatermark("ts", delay)
    rows = rows.select("key", "id", F.unix_micros("ts").alias("at"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "ts")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Buffer(limits), outputStructType=f"key {kind}, {CELL}", outputMode="Append", timeMode="EventTime")
