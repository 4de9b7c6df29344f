import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.streaming import buffers as B

SHAPE = "key long, id long, ts timestamp, tokens long"
START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def made(seed, n, keys):
    r, at, out = np.random.default_rng(seed), 0, []
    for k in range(n):
        at += int(r.choice([1, 20, 60, 400, 4000], p=[0.3, 0.3, 0.2, 0.15, 0.05]))
        out.append((int(r.integers(0, keys)), k, START + dt.timedelta(seconds=at, microseconds=int(r.integers(0, 1000)) * 1000), int(r.integers(0, 60))))
    return out


def plain(rows, most, tokens, gap):
    out, cells = [], {}
    for key, message, ts, size in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        c, size = cells.get(key), size or 0
        if c and (len(c) >= most or sum(x[2] for x in c) + size > tokens or (ts - c[-1][1]).total_seconds() > gap):
            out.append((key, c))
            c = None
        cells[key] = (c or []) + [(message, ts, size)]
    micros = lambda t: round((t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds() * 1e6)
    return {(k, micros(c[0][1]), micros(c[-1][1]), len(c), sum(x[2] for x in c), c[0][0]) for k, c in [*out, *cells.items()]}


@pytest.mark.parametrize("most, tokens, gap", [(5, 10_000, 10_000), (1000, 100, 10_000), (1000, 10_000, 300), (7, 200, 600), (1, 1, 1)])
def test_batch_equals_a_plain_fold(spark, most, tokens, gap):
    rows = made(1, 400, 4) + [(1, 1000, None, 5), (9, 1001, START, None), (9, 1002, START, 500)]
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    assert {tuple(r) for r in B.message_cells(df, B.Limits(most, tokens, gap)).collect()} == plain(rows, most, tokens, gap)
    assert B.message_cells(df.limit(0), B.Limits()).count() == 0


def test_stream_equals_batch_over_a_restart_with_late_rows(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = made(2, 120, 3)
    r = np.random.default_rng(0)
    late = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=float(r.integers(0, 250))))  # out of order, within the delay
    far = (0, 5000, START + dt.timedelta(days=3), 1)
    gone = (1, 6000, START, 1)  # arrives when the watermark is long past it
    parts = [late[:40], late[40:80], [*late[80:], far], [gone, (2, 5001, START + dt.timedelta(days=4), 1)], [(2, 5002, START + dt.timedelta(days=9), 1)], [(2, 5003, START + dt.timedelta(days=20), 1)]]

    def put(k, part):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(f"{folder}/in/{k}")

    def run():
        source = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        cells = B.streamed_cells(source, B.Limits(6, 150, 600), "5 minutes")
        q = cells.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    for k in (0, 1):
        put(k, parts[k])
    run()
    for k in (2, 3, 4, 5):
        put(k, parts[k])
        run()  # each run goes on from the checkpoint
    got = {tuple(x) for x in spark.read.parquet(f"{folder}/out").select("key", "start", "end", "n", "tokens", "first_id").collect()}
    want = plain([*rows, far, parts[3][1], *parts[4]], 6, 150, 600)
    assert got == want  # the row that came too late is in no cell, and the last one is still open
