import struct

import pytest
from pyspark.sql import functions as F

from nxtide.sources import capture, readers


def dns(ident, name, response=False, rcode=0, answers=(), qcode=1):
    question = b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0" + struct.pack(">HH", qcode, 1)
    body = b"".join(b"\xc0\x0c" + struct.pack(">HHIH", kind, 1, 60, len(data)) + data for kind, data in answers)
    return struct.pack(">HHHHHH", ident, 0x8400 * response | rcode, 1, len(answers), 0, 0) + question + body


def ip(payload, kind, src="10.0.0.1", dst="10.0.0.2", ident=1, offset=0, more=False):
    address = lambda a: bytes(map(int, a.split(".")))
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), ident, 0x2000 * more | offset // 8, 64, kind, 0)
    return head + address(src) + address(dst) + payload


def udp(data, to=53):
    return struct.pack(">HHHH", 5353, to, 8 + len(data), 0) + data


def tcp(data, seq):
    return struct.pack(">HHIIBBHHH", 5353, 53, seq, 0, 0x50, 0x18, 0, 0, 0) + data


def capture_file(frames, tag=b""):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for t, packet in frames:
        frame = b"\0" * 12 + tag + b"\x08\x00" + packet
        out += struct.pack("<IIII", int(t), int(round(t % 1 * 1e6)), len(frame), len(frame)) + frame
    return out


def test_capture(spark, tmp_path):
    answer = dns(1, "a.example.com", True, answers=[(1, bytes([1, 2, 3, 4])), (5, b"\x01b\xc0\x0e")])
    long = dns(2, "frag.example.com", True, 3)
    whole = udp(long)
    stream = struct.pack(">H", len(answer)) + answer
    frames = [
        (1.0, ip(udp(dns(1, "A.example.com")), 17)), (1.5, ip(udp(answer), 17)), (2.0, ip(whole[:16], 17, ident=7, more=True)), (2.1, ip(whole[16:], 17, ident=7, offset=16)),
        (3.0, ip(tcp(stream[20:], 120), 6)), (3.1, ip(tcp(stream[:20], 100), 6)), (3.2, ip(udp(b"x" * 30, 80), 17)), (3.3, ip(udp(b"short"), 17)),
    ]
    (tmp_path / "a.pcap").write_bytes(capture_file(frames, b"\x81\x00\x00\x05") + b"\0\0\0\0cut")
    capture.register(spark)
    for df in (spark.read.format("dns_capture").load(str(tmp_path)), capture.read_captures(spark, str(tmp_path))):
        rows = [(r["time"], r["protocol"], r["qr"], r["AA"], r["rcode"], r["dn"], r["answer"]) for r in df.orderBy("time").collect()]
        assert rows == [
            (1.0, "u", "q", None, 0, "a.example.com", None), (1.5, "u", "r", "1", 0, "a.example.com", "1.2.3.4"),
            (2.1, "u", "r", "1", 3, "frag.example.com", None), (3.1, "t", "r", "1", 0, "a.example.com", "1.2.3.4"),
        ]


@pytest.mark.parametrize("kind, data, want", [
    (2, b"\x02ns\x00", "ns"), (15, b"\0\x0a\x02mx\x00", "10,mx"), (16, b"\x02hi\x03you", "hi you"), (28, bytes(15) + b"\x01", "::1"),
    (33, b"\0\1\0\2\0\3\1s\0", "1,2,3,s"), (6, b"\1a\0\1b\0" + bytes(20), "a,b,0,0,0,0,0"), (43, b"\0\1\2\3\xff", "1,2,3,ff"), (48, b"\1\1\3\x08\xaa", "257,3,8,aa"), (99, b"\x01\x02", "0102"),
])
def test_record_types(kind, data, want):
    assert capture.value_of(kind, data, 0, len(data)) == want


def test_broken_messages():
    loop = struct.pack(">HHHHHH", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c\0\1\0\1"
    assert capture.dns_row(loop) is None and capture.dns_row(b"abc") is None


def test_message_csv(spark, tmp_path):
    rows = [(1.5, 40, "u", "a", "b", "q", None, 0, 1, 1, 0, 0, 0, 1, "x.com", 'say "hi";1')]
    readers.write_csv(spark.createDataFrame(rows, readers.RAW_MESSAGE), str(tmp_path / "m"))
    back = readers.read_messages(spark, str(tmp_path / "m"))
    assert [tuple(r) for r in back.collect()] == rows
    assert readers.messages_of(back).first()["is_r"] is False
    readers.append_messages(back.withColumn("pcap_id", F.lit(4)), str(tmp_path / "t"))
    readers.append_messages(back.withColumn("pcap_id", F.lit(5)), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("pcap_id = 5").count() == 1


def test_appends_of_many_captures_make_few_files(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").alias("dn_id"), F.when(F.col("id") > 0, F.col("id") % 2000).alias("pcap_id"))
    for _ in range(2):
        readers.append_messages(rows, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 2 * 8 * readers.CAPTURE_PARTS
    assert sorted(map(str, back.select("dn_id", "pcap_id").collect())) == sorted(2 * list(map(str, rows.collect())))
    own = back.filter((F.col("pcap_part") == readers.capture_part(F.lit(5))) & (F.col("pcap_id") == 5))
    assert sorted(r["dn_id"] for r in own.collect()) == [5, 5, 2005, 2005, 4005, 4005]


def test_archive_lists_tables_objects(spark, tmp_path):
    (tmp_path / "3.csv").write_text("a.com,1,fam_dga_ff\n")
    (tmp_path / "5.csv").write_text("b.com,2,2020-01-01 00:00:00,bad,other\n")
    rows = {r["dn"]: r for r in readers.read_archive(spark, [str(tmp_path / "3.csv")], [str(tmp_path / "5.csv")]).collect()}
    assert (rows["a.com"]["family"], rows["a.com"]["hash"], rows["a.com"]["begin"]) == ("fam", "ff", None)
    assert rows["b.com"]["begin"].year == 2020 and rows["b.com"]["end"] is None and rows["b.com"]["hash"] is None
    (tmp_path / "psl").write_text("// ===BEGIN ICANN DOMAINS===\n// jp : Japan\njp\nco.jp\n\n// ===BEGIN PRIVATE DOMAINS===\n// D\nddns.net\n")
    assert sorted((r[0], r[1]) for r in readers.read_suffix_list(spark, str(tmp_path / "psl")).collect()) == [("co.jp", "icann"), ("ddns.net", "private"), ("jp", "icann")]
    spark.udtf.register("html_table", readers.html_table())
    html = "<table id='x'><tr><th>A</th><th>B</th></tr><tr><td>1 <b>2</b></td><td>3</td></tr></table><table><tr><td>no</td></tr></table>"
    assert [r["cells"] for r in spark.sql(f"SELECT * FROM html_table(\"{html}\", 'x')").collect()] == [["A", "B"], ["1 2", "3"]]
    readers.write_objects(spark.createDataFrame([("o", b"data")], "name string, data binary"), str(tmp_path / "o"))
    assert readers.read_objects(spark, str(tmp_path / "o")).first()["data"] == b"data"
    (tmp_path / "w.csv").write_text("id,eps,eps\n-,TLD,ICANN\n1,0.5,0.6\nid,0.5,eps\n-,TLD,ICANN\n")  # rows like header rows are rows
    flat = readers.flattened(spark, str(tmp_path / "w.csv"), 2)
    assert flat.columns == ["id", "eps_TLD", "eps_ICANN"] and sorted(tuple(r) for r in flat.collect()) == [("-", "TLD", "ICANN"), ("1", "0.5", "0.6"), ("id", "0.5", "eps")]
