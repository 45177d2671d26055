from datetime import datetime, timedelta

import pytest

from nxtide.streaming import streams

SCHEMA = "id long, pcap_id long, dn_id long, ts timestamp, is_r boolean, rcode int"


@pytest.fixture
def stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 2, i % 7, start + timedelta(minutes=5 * i), i % 3 == 2, 3 if i % 6 == 5 else 0) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), rows, tmp_path


def run(df, tmp_path, mode="append"):
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_slots(stream):
    df, rows, tmp = stream
    out = run(streams.slot_counts(df), tmp, "update")
    last = {}
    for r in out:
        last[r["slot"]["start"]] = max(last.get(r["slot"]["start"], 0), r["qr"])
    assert sum(last.values()) == len(rows) and set(last.values()) == {12}


def test_first_seen(stream):
    df, rows, tmp = stream
    assert len(run(streams.first_seen(df), tmp)) == 7


def test_count_windows(stream):
    df, rows, tmp = stream
    got = sorted(tuple(r) for r in run(streams.count_windows(df, 5), tmp))
    want = []
    for capture in (0, 1):
        wnum, seen, qr, q, nx = 0, 0, 0, 0, 0
        for i, p, _, _, is_r, rcode in rows:
            if p != capture:
                continue
            if not is_r:
                if seen and seen % 5 == 0:
                    want.append((capture, wnum, qr, q, nx))
                    wnum, qr, q, nx = wnum + 1, 0, 0, 0
                seen, q = seen + 1, q + 1
            qr, nx = qr + 1, nx + (is_r and rcode == 3)
    assert got == sorted(want)


def test_sessions(stream):
    df, rows, tmp = stream
    out = run(streams.sessions(df.withColumnRenamed("pcap_id", "flow"), "9 minutes", "1 minute"), tmp, "append")
    # each message is its own session; the watermark is a minute before the last one, at 295 minutes
    assert sum(r["packets"] for r in out) == len(out) == sum(5 * i + 9 <= 294 for i in range(60))
