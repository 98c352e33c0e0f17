import datetime as dt
import json
import os

from pyspark.sql import functions as F

from veilspark.functions.text import mask_log
from veilspark.plans.scan import scan
from veilspark.streaming.streams import audit_rollup, drain, mask_log_stream, rate_alerts, scan_stream

T0 = dt.datetime(2024, 1, 1)


def write_batches(path, batches):
    path.mkdir()
    for i, rows in enumerate(batches):
        file = path / f"{i}.json"
        file.write_text("\n".join(json.dumps(r, default=str) for r in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in this order
    return str(path)


def read(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def test_scan_and_mask_streams_equal_batch(spark, tmp_path):
    rows = [{"doc_id": i, "text": f"bel 06-1234567{i} of mail u{i}@x.nl"} for i in range(6)]
    path = write_batches(tmp_path / "in", [rows[:3], rows[3:]])
    schema = "doc_id long, text string"
    batch = spark.read.schema(schema).json(path)
    streamed = drain(spark, scan_stream(read(spark, path, schema), "deep"))
    assert sorted(map(str, streamed.collect())) == sorted(map(str, scan(batch, "deep").collect()))
    masked = drain(spark, mask_log_stream(read(spark, path, schema), "text"))
    assert sorted(masked.collect()) == sorted(batch.withColumn("text", mask_log(F.col("text"))).collect())


def test_late_rows_are_dropped(spark, tmp_path):
    def row(minutes, n=1):
        return {"ts": (T0 + dt.timedelta(minutes=minutes)).isoformat(), "event": "scan_text", "findings_count": n}

    # the fourth batch is later than the watermark, its rows count nowhere
    path = write_batches(tmp_path / "in", [[row(5, 2), row(10, 3)], [row(130)], [row(131)], [row(20, 100)], [row(300)]])
    out = drain(spark, audit_rollup(read(spark, path, "ts timestamp, event string, findings_count long"))).collect()
    got = {r["window_start"]: (r["n_scans"], r["n_findings"]) for r in out}
    assert got == {T0: (2, 5), T0 + dt.timedelta(hours=2): (2, 2)}


def test_rate_alerts(spark, tmp_path):
    def row(user, seconds):
        return {"user_id": user, "ts": (T0 + dt.timedelta(seconds=seconds)).isoformat()}

    rows = [row(1, i) for i in range(31)] + [row(2, i) for i in range(30)] + [row(3, 50 + i) for i in range(40)]
    path = write_batches(tmp_path / "in", [rows, [row(9, 7200)], [row(9, 7201)]])
    schema = "user_id long, ts timestamp"
    tumbling = drain(spark, rate_alerts(read(spark, path, schema)))
    assert [(r["user_id"], r["n_requests"]) for r in tumbling.collect()] == [(1, 31)]
    sliding = drain(spark, rate_alerts(read(spark, path, schema), slide="30 seconds"))
    assert {r["user_id"] for r in sliding.collect()} == {1, 3}
    sessions = drain(spark, rate_alerts(read(spark, path, schema), session_gap="60 seconds"))
    assert {(r["user_id"], r["n_requests"]) for r in sessions.collect()} == {(1, 31), (3, 40)}
