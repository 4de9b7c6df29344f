"""Pages that join the most similar session of their key, of which a key keeps a few: in batch, and as keyed map state in streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Of each page: the session that it joined or opened (numbers from 0 in each key), its score there, whether it opened it, and the session that went for it.
FOUND = "id long, session long, score double, opened boolean, evicted long"
_NAMES = ["key", "id", "session", "score", "opened", "evicted"]


class Merging:
    """How pages meet sessions.

    A session is known by the vector and the words of the page that opened it. The most similar one (cosine of at least 0, ties to the older) takes a page if the cosine and the mean share
    of common words in both sets come to `least` together; else the page opens a session, and if there are more than `capacity`, the least visited goes, the oldest of them first:
    the new one too, where all others were visited. A visit counts for each session whose own sum is at least `near`.
    """

    def __init__(self, capacity: int = 2000, least: float = 0.6, near: float = 0.6):
        if capacity < 1:
            raise ValueError("a key keeps one session at least")
        self.capacity, self.least, self.near = capacity, least, near

    @staticmethod
    def common(a: frozenset, b: frozenset) -> float:
        shared = len(a & b)
        return 0.5 * (shared / len(a) + shared / len(b)) if shared else 0.0

    @staticmethod
    def unit(vector) -> np.ndarray:
        x = np.asarray(vector, float)
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    def take(self, sessions: dict, number: int, vector: np.ndarray, words: frozenset) -> tuple[int, float | None, bool, int | None]:
        """The session, score, opened and evicted of a page; sessions (number: vector, words, pages, visits; from the oldest on) are changed. A new one gets `number`."""
        best, near = None, -1.0
        for k, s in sessions.items():
            if len(s[0]) == len(vector) and (found := round(float(s[0] @ vector), 9)) > near:
                best, near = k, found
        if best is not None and near >= 0:
            score = round(near + self.common(sessions[best][1], words), 9)
            if score >= self.least:
                sessions[best][2] += 1
                return best, score, False, None
        sessions[number] = [vector, words, 1, 0]
        gone = min(sessions, key=lambda k: sessions[k][3]) if len(sessions) > self.capacity else None
        if gone is not None:
            del sessions[gone]
        return number, None, True, gone

    def visit(self, sessions: dict, vector: np.ndarray, words: frozenset) -> None:
        for s in sessions.values():
            if len(s[0]) == len(vector) and round(float(s[0] @ vector) + self.common(s[1], words), 9) >= self.near:
                s[3] += 1


def _sound(rows: DataFrame) -> DataFrame:
    """Rows with a key, an id, a time and a finite vector that isn't zero; null words are none, and a null visit is a page."""
    x = F.col("vector").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    words = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("words", F.array().cast("array<string>")))))
    kept = rows.where("key is not null and id is not null and ts is not null").where(F.coalesce(fine, F.lit(False)))
    return kept.withColumns({"id": F.col("id").cast("long"), "vector": x, "words": words, "visit": F.coalesce("visit", F.lit(False))}).select("key", "id", "ts", "vector", "words", "visit")


def merged_sessions(rows: DataFrame, how: Merging) -> DataFrame:
    """key and FOUND for each page of rows (key, id, ts, vector, words, visit), read in the order of ts, then id; visits have no row.

    The order makes each key sequential, so a key is read by one task, row by row: it holds `capacity` sessions at most, whatever the key's number of rows. Rows without
    key, id, ts or a sound vector are left out.
    """
    kind = rows.schema["key"].dataType.simpleString()
    dealt = _sound(rows).repartition("key").sortWithinPartitions("key", "ts", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sessions, number = None, {}, 0
        for b in batches:
            out = []
            for k, i, vector, words, visit in zip(*(b.column(c).to_pylist() for c in ("key", "id", "vector", "words", "visit")), strict=True):
                if k != key:
                    key, sessions, number = k, {}, 0
                x, own = how.unit(vector), frozenset(words)
                if visit:
                    how.visit(sessions, x, own)
                    continue
                found = how.take(sessions, number, x, own)
                number += found[2]
                out.append((k, i, *found))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [b.column("key").type, pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)

    return dealt.select("key", "id", "vector", "words", "visit").mapInArrow(run, f"key {kind}, {FOUND}")


class _Keeper(StatefulProcessor):
    """Rows wait until the watermark passes them, then meet the key's sessions in order."""

    def __init__(self, how: Merging):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "number long", "vector array<double>, words array<string>, pages long, visits long")
        self.next = handle.getValueState("next", "number long")
        self.waiting = handle.getListState("waiting", "at long, id long, vector array<double>, words array<string>, visit boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for part in rows:
            for at, i, vector, words, visit in zip(part["at"], part["id"], part["vector"], part["words"], part["visit"], strict=True):
                self.waiting.appendValue((int(at), int(i), [float(v) for v in vector], [str(w) for w in words], bool(visit)))
                times.add(int(at) // 1000 + 1)
        for ms in times:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        waiting = sorted((tuple(w) for w in self.waiting.get()), key=lambda w: w[:2]) if self.waiting.exists() else []
        ready, later = [w for w in waiting if w[0] < upto], [w for w in waiting if w[0] >= upto]
        if not ready:
            return
        held = {k[0]: [np.array(v[0], float), frozenset(v[1]), v[2], v[3]] for k, v in self.sessions.iterator()} if self.sessions.exists() else {}
        sessions = {k: held[k] for k in sorted(held)}
        before = {k: (s[2], s[3]) for k, s in sessions.items()}
        number, out = self.next.get()[0] if self.next.exists() else 0, []
        for _, i, vector, words, visit in ready:
            x, own = self.how.unit(vector), frozenset(words)
            if visit:
                self.how.visit(sessions, x, own)
                continue
            found = self.how.take(sessions, number, x, own)
            number += found[2]
            out.append((*key, i, *found))
        for k in before.keys() - sessions.keys():
            self.sessions.removeKey((k,))
        for k, s in sessions.items():
            if before.get(k) != (s[2], s[3]):
                self.sessions.updateValue((k,), (s[0].tolist(), sorted(s[1]), s[2], s[3]))
        self.next.update((number,))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        if out:
            yield pd.DataFrame(out, columns=_NAMES).astype({"score": "float64", "evicted": "Int64"})

    def close(self) -> None:
        pass


def streamed_sessions(rows: DataFrame, how: Merging, delay: str = "10 minutes") -> DataFrame:
    """merged_sessions() of a stream: rows up to `delay` late have their place, later ones are dropped. A page comes out when the watermark has passed it.

    A key's state is `capacity` sessions at most, the next number, and the rows that the watermark hasn't passed. The session needs the RocksDB state store.
    """
    kind = rows.schema["key"].dataType.simpleString()
    sound = _sound(rows).withWatermark("ts", delay).select("key", "id", F.unix_micros("ts").alias("at"), "vector", "words", "visit", "ts")
    return sound.groupBy("key").transformWithStateInPandas(statefulProcessor=_Keeper(how), outputStructType=f"key {kind}, {FOUND}", outputMode="Append", timeMode="EventTime")
