import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.streaming import merged_sessions as M

SHAPE = "key long, id long, ts timestamp, vector array<double>, words array<string>, visit boolean"
START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def made(seed, n, keys):
    r, out = np.random.default_rng(seed), []
    base = r.normal(size=(6, 4))
    for k in range(n):
        topic = int(r.integers(0, 6))
        words = [f"w{topic}{int(w)}" for w in r.integers(0, 3, int(r.integers(0, 4)))]
        out.append((int(r.integers(0, keys)), k, START + dt.timedelta(seconds=20 * (k // 2)), (base[topic] + 0.6 * r.normal(size=4)).tolist(), words, bool(r.random() < 0.2)))
    return out


def plain(rows, capacity, least, near):
    """By lists and loops, from the definition."""
    out, keys = set(), {}
    for key, i, _, v, words, visit in sorted(rows, key=lambda x: (x[2], x[1])):
        sessions, opened = keys.setdefault(key, ([], [0]))
        words, length = set(words or []), sum(a * a for a in v) ** 0.5

        def score(s):
            cosine = sum(a * b for a, b in zip(s["v"], v)) / (length * sum(a * a for a in s["v"]) ** 0.5)  # noqa: B023
            both = s["w"] & words  # noqa: B023
            return cosine, (len(both) / len(s["w"]) + len(both) / len(words)) / 2 if both else 0.0  # noqa: B023

        if visit:
            for s in sessions:
                s["visits"] += sum(score(s)) >= near
            continue
        ranked = sorted(sessions, key=lambda s: (-score(s)[0], s["n"]))
        if ranked and score(ranked[0])[0] >= 0 and sum(score(ranked[0])) >= least:
            out.add((key, i, ranked[0]["n"], round(sum(score(ranked[0])), 6), False, None))
            continue
        sessions.append({"n": opened[0], "v": v, "w": words, "visits": 0})
        gone = None
        if len(sessions) > capacity:
            least_visited = min(sessions, key=lambda s: (s["visits"], s["n"]))
            sessions.remove(least_visited)
            gone = least_visited["n"]
        out.add((key, i, opened[0], None, True, gone))
        opened[0] += 1
    return out


def tuples(df):
    return {(r.key, r.id, r.session, None if r.score is None else round(r.score, 6), r.opened, r.evicted) for r in df.collect()}


@pytest.mark.parametrize("capacity, least, near", [(3, 1.0, 0.9), (1, 0.9, 0.2), (100, 1.2, 0.6)])
def test_batch_equals_plain_loops(spark, capacity, least, near):
    rows = made(1, 300, 4)
    got = tuples(M.merged_sessions(spark.createDataFrame(rows, SHAPE).repartition(5).withColumn("at", F.lit("x")), M.Merging(capacity, least, near)))
    want = plain(rows, capacity, least, near)
    assert got == want and any(r[4] for r in want) and not all(r[4] for r in want)
    assert capacity == 100 or any(r[5] is not None for r in want)


def test_the_new_session_goes_where_all_others_were_visited_and_odd_rows(spark):
    t = lambda k: START + dt.timedelta(seconds=k)
    rows = [(1, 1, t(1), [1.0, 0.0], ["a"], None), (1, 2, t(2), [1.0, 0.0], ["a"], True), (1, 3, t(3), [-1.0, 0.0], ["b"], False), (1, 4, t(4), [1.0, 0.0, 0.0], None, False)]
    odd = [(1, 5, t(5), None, None, False), (1, 6, t(5), [0.0, 0.0], [], False), (1, 7, t(5), [float("nan"), 1.0], [], False), (None, 8, t(5), [1.0, 0.0], [], False), (1, 9, None, [1.0, 0.0], [], False), (1, 10, t(9), [2.0, 0.0], [None, "a"], False), (1, 10, t(9), [2.0, 0.0], [], False)]
    df = spark.createDataFrame(rows + odd, SHAPE)
    got = sorted((r.id, r.session, r.opened, r.evicted) for r in M.merged_sessions(df, M.Merging(1)).collect())
    assert got == [(1, 0, True, None), (3, 1, True, 1), (4, 2, True, 2), (10, 0, False, None), (10, 0, False, None)]
    assert M.merged_sessions(df.limit(0), M.Merging()).count() == 0
    with pytest.raises(ValueError):
        M.Merging(0)


def test_stream_equals_batch_over_a_restart_with_late_rows(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows, how = made(2, 120, 3), M.Merging(3, 1.0, 0.9)
    r = np.random.default_rng(0)
    late = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=float(r.integers(0, 250))))
    far = [(7, 900, START + dt.timedelta(days=2), [1.0, 0.0, 0.0, 0.0], [], False)]
    gone = (1, 901, START, [1.0, 0.0, 0.0, 0.0], [], False)  # arrives when the watermark is long past it
    for k, part in enumerate([late[:50], late[50:] + far, [gone, (7, 902, START + dt.timedelta(days=4), [1.0, 0.0, 0.0, 0.0], [], False)]]):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.parquet(f"{folder}/in/{k}")
        source = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        q = M.streamed_sessions(source, how, "5 minutes").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    got = tuples(spark.read.parquet(f"{folder}/out"))
    assert got == plain(rows + far, 3, 1.0, 0.9)  # the late row has no place, and the last one still waits
