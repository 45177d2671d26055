"""Flows, rings and count windows with late rows: streams that are stopped and restarted, and batches, against plain versions."""

import random
from collections import deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from nxtide.operators import flows as batch
from nxtide.streaming import stateful

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SECOND = 1_000_000


@pytest.fixture(autouse=True)
def store(spark):
    for k, v in stateful.STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for k in stateful.STORE:
        spark.conf.unset(k)


class Feed:
    """Files that a stream reads one by one, in runs with one checkpoint."""

    def __init__(self, spark, tmp, schema, make):
        self.spark, self.tmp, self.schema, self.make, self.n = spark, tmp, schema, make, 0

    def run(self, files):
        for rows in files:
            df = self.spark.createDataFrame(rows, self.schema).coalesce(1)
            df.write.parquet(str(self.tmp / "in" / f"{self.n:03d}"))
            self.n += 1
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(self.tmp / "in"))
        q = self.make(stream).writeStream.format("parquet").option("path", str(self.tmp / "out")).option("checkpointLocation", str(self.tmp / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None and not q.isActive

    def out(self):
        return self.spark.read.parquet(str(self.tmp / "out"))


def at(us):
    return START + timedelta(microseconds=us)


def micros(us):
    return int(START.timestamp()) * SECOND + us


SEGMENT = "flow long, ts timestamp, seq long, id long, data binary"


def segments(seed):
    """Segments of several flows: out of order by places, repeated, overlapping, with holes, and across the wrap."""
    rng, rows = random.Random(seed), []
    for flow in range(4):
        t, place = rng.randrange(SECOND), stateful.WRAP - rng.randrange(1, 200) if flow % 2 else rng.randrange(1000)
        for _ in range(60):
            t += rng.choice([1000, 20_000, 300_000, 500_000, 500_001, 900_000])
            data = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 30])))
            rows.append((flow, t, (place + rng.choice([0, 0, 0, -7, 12])) % stateful.WRAP, len(rows), data))
            place += len(data)
    rows += [rows[5], rows[70]]
    return rows


def plain_flows(rows, gap=500_000):
    out = []
    for flow in {r[0] for r in rows}:
        open_ = []
        for r in [*sorted((r for r in rows if r[0] == flow), key=lambda r: r[1:4]), None]:
            if open_ and (r is None or r[1] - open_[-1][1] > gap):
                place, placed = open_[0][2], []
                last = place
                for s in open_:
                    place += (s[2] - last + stateful.WRAP // 2) % stateful.WRAP - stateful.WRAP // 2
                    last = s[2]
                    placed.append((place, s))
                placed.sort(key=lambda x: (x[0], x[1][1:4]))
                stream, low = {}, placed[0][0]
                for p, s in placed:
                    for i, b in enumerate(s[4]):
                        stream.setdefault(p + i, b)
                payload = bytes(stream[i] for i in sorted(stream))
                top = max(p + len(s[4]) for p, s in placed)
                reach, holes = low, 0
                for p, s in placed:
                    holes += max(0, p - reach)
                    reach = max(reach, p + len(s[4]))
                assert top == reach
                out.append((flow, len(open_), micros(open_[0][1]), micros(open_[-1][1]), low % stateful.WRAP, len(payload), holes, payload))
                open_ = []
            if r:
                open_.append(r)
    return sorted(out)


def flow_rows(df):
    return sorted((r["flow"], r["packets"], r["first"], r["last"], r["start_seq"], r["bytes"], r["missing"], bytes(r["payload"])) for r in df.collect())


@pytest.mark.parametrize("bucket", [batch.BUCKET, 700_000])
def test_flows_of_a_table(spark, bucket):
    rows = segments(1)
    df = spark.createDataFrame([(f, micros(t), s, i, d) for f, t, s, i, d in rows], "flow long, t long, seq long, id long, data binary")
    assert flow_rows(batch.flows(df, bucket=bucket)) == plain_flows(rows)
    odd = spark.createDataFrame([(None, 5, 1, 1, None), (None, 6, 1, 2, b"x"), (1, 7, 1, 1, b"")], "flow long, t long, seq long, id long, data binary")
    assert sorted((str(r["flow"]), r["packets"], bytes(r["payload"])) for r in batch.flows(odd).collect()) == [("1", 1, b""), ("None", 2, b"x")]
    assert batch.flows(df.limit(0)).count() == 0


def test_flows_of_a_stream_that_is_restarted(spark, tmp_path):
    rows = segments(2)
    rng = random.Random(9)
    by_time = sorted(rows, key=lambda r: r[1] + rng.randrange(-900_000, 900_000))  # out of order within the wait
    feed = Feed(spark, tmp_path, SEGMENT, lambda s: stateful.flows(s, late="2 seconds"))
    shaped = [(f, at(t), s, i, d) for f, t, s, i, d in by_time]
    feed.run([shaped[k::1][:40] for k in range(0, 80, 40)])  # stopped with flows open
    held = feed.out().count()
    feed.run([shaped[80:160], shaped[160:]])
    feed.run([[(99, at(10**9), 0, 0, b"")], [(99, at(10**9 + 1), 0, 0, b"")]])
    out = feed.out()
    assert out.filter("late").count() == 0 and held < out.count()
    assert flow_rows(out.filter("flow <> 99")) == plain_flows(rows)
    feed.run([[(0, at(5), 7, 1, b"late")]])
    (late,) = feed.out().filter("late").collect()
    assert (late["flow"], late["first"], bytes(late["payload"])) == (0, micros(5), b"late")


def plain_recent(rows, last, by):
    rings, out = {}, []
    for r in rows:
        ring = rings.setdefault(r[by], deque(maxlen=last) if last else deque(maxlen=0))
        if r[2] not in ring:
            ring.append(r[2])
            out.append(r)
    return out


def names(seed, n=600):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(rng.choice([3, 8, 40]))]), i * 37 * SECOND) for i in range(n)]


@pytest.mark.parametrize("last", [1, 3, 10_000])
def test_ring_of_a_table(spark, last):
    rows = names(last)
    df = spark.createDataFrame(rows, "id long, pcap_id long, dn_id long, t long").repartition(4)
    for bucket in (10**12, 600 * SECOND):
        got = sorted(r["id"] for r in batch.without_recent(df, "dn_id", last, bucket=bucket).collect())
        assert got == [r[0] for r in plain_recent(rows, last, 1)]
    assert batch.without_recent(df.limit(0), "dn_id", last).count() == 0


@pytest.mark.parametrize("last", [1, 3, 10_000])
def test_ring_of_a_stream_that_is_restarted(spark, tmp_path, last):
    rows = [(i, p, d, t, (2**60 + 1 if i % 2 else None)) for i, p, d, t in names(last + 1, 240)]
    feed = Feed(spark, tmp_path, "id long, pcap_id long, dn_id long, t long, big long", lambda s: stateful.without_recent(s, "dn_id", last, order=("id",)))
    feed.run([rows[:60], rows[60:110]])
    feed.run([rows[110:111], rows[111:]])
    assert sorted(tuple(r) for r in feed.out().select("id", "big").collect()) == sorted((r[0], r[4]) for r in plain_recent(rows, last, 1))


MESSAGE = "pcap_id long, ts timestamp, id long, is_r boolean, rcode int"


def plain_windows(rows, size):
    out = []
    for capture in {r[0] for r in rows}:
        wnum, seen, qr, q, nx = 0, 0, 0, 0, 0
        for _, t, i, is_r, rcode in sorted((r for r in rows if r[0] == capture), key=lambda r: r[1:3]):
            if not is_r:
                if seen and seen % size == 0:
                    out.append((capture, wnum, qr, q, nx))
                    wnum, qr, q, nx = wnum + 1, 0, 0, 0
                seen, q = seen + 1, q + 1
            qr, nx = qr + 1, nx + int(bool(is_r) and rcode == 3)
    return sorted(out)


def test_count_windows_with_late_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 2, i * 20 * SECOND, i, rng.random() < 0.4, rng.choice([0, 3, None])) for i in range(300)]
    late = [(0, 100 * 20 * SECOND + 1, 1000, False, 0), (1, 3, 1001, True, 3)]
    shuffled = sorted(rows, key=lambda r: r[1] + rng.randrange(-200, 200) * SECOND)  # within the wait of ten minutes
    shaped = lambda some: [(p, at(t), i, r, c) for p, t, i, r, c in some]
    feed = Feed(spark, tmp_path, MESSAGE, lambda s: stateful.count_windows(s, 7))
    feed.run([shaped(shuffled[:90]), shaped(shuffled[90:140])])
    feed.run([shaped(shuffled[140:]), shaped(late), shaped([(5, 10**11, 5000, True, 0)]), shaped([(5, 10**11 + 1, 5001, True, 0)])])
    windows, missed = stateful.split(feed.out())
    assert sorted(tuple(r) for r in windows.collect()) == plain_windows(rows, 7)
    assert sorted((r["pcap_id"], r["t"], r["id"]) for r in missed.collect()) == sorted((p, micros(t), i) for p, t, i, _, _ in late)
    assert dict(missed.dtypes) == {"pcap_id": "bigint", "t": "bigint", "id": "bigint"} and windows.filter(F.col("q") != 7).count() == 0


def test_ring_query_equals_a_plain_ring(spark, tiny):
    from nxtide.plans import registry, streamed

    rows = sorted(((r["id"], r["pcap_id"], r["dn_id"], r["t"]) for r in streamed.messages(spark.read.parquet(f"{tiny}/events.parquet")).collect()), key=lambda r: (r[3], r[0]))
    assert sorted(tuple(r) for r in registry.queries()["stm5_recent_hashes"](spark, tiny).collect()) == sorted(plain_recent(rows, 10, 1))
