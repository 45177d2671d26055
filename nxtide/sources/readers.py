"""Readers and writers: message CSV, lists with sections, archives with several layouts, HTML tables, object stores with digests."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from nxtide.sources.headed import read_headed

RAW_MESSAGE = "time double, size int, protocol string, src string, dst string, qr string, AA string, rcode int, fnreq long, qdcount int, ancount int, nscount int, arcount int, qcode int, dn string, answer string"
#: Folders of a table of messages, among which captures are dealt.
CAPTURE_PARTS = 64
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_MESSAGE).options(**CSV).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, quote='"', escape='"', escapeQuotes=True).mode("overwrite").csv(path)


def capture_part(pcap_id: Column) -> Column:
    """Which of the parts of append_messages() a capture lies in: a reader of one capture filters by `pcap_part` too."""
    return F.pmod(F.xxhash64(pcap_id.cast("string")), F.lit(CAPTURE_PARTS))


def append_messages(df: DataFrame, path: str) -> None:
    """Appends to a table partitioned by capture_part() of the captures, in which a capture's rows lie together.

    Rows are dealt by part and a salt of 8, so that a large capture is written by several tasks: an append makes 8 * CAPTURE_PARTS files at most, however many
    captures there are.
    """
    placed = df.withColumn("pcap_part", capture_part(F.col("pcap_id")))
    salted = placed.repartition("pcap_part", F.pmod(F.xxhash64(*df.columns), F.lit(8))).sortWithinPartitions("pcap_part", "pcap_id")
    salted.write.mode("append").partitionBy("pcap_part").parquet(path)


def messages_of(raw: DataFrame) -> DataFrame:
    """Message rows of a parsed capture: is_r, and columns with their names in the message table."""
    return raw.select(F.col("time").alias("time_s"), "src", "dst", F.col("fnreq").alias("fn_req"), "qcode", (F.col("qr") == "r").alias("is_r"), "rcode", "dn", "answer")


def read_archive(spark: SparkSession, three: list[str], five: list[str]) -> DataFrame:
    """(dn, archive_id, begin, end, family, hash) of files with three columns, and with five; families are split at _dga_."""
    narrow = spark.read.schema("dn string, archive_id string, family string").csv(three) if three else None
    wide = spark.read.schema("dn string, archive_id string, begin string, end string, family string").csv(five) if five else None
    both = wide.unionByName(narrow, allowMissingColumns=True) if wide is not None and narrow is not None else wide if wide is not None else narrow
    for c in ("begin", "end"):
        both = both.withColumn(c, F.col(c)) if c in both.columns else both.withColumn(c, F.lit(None).cast("string"))
    parts = F.split("family", "_dga_", 2)
    return both.select("dn", "archive_id", F.try_to_timestamp("begin").alias("begin"), F.try_to_timestamp("end").alias("end"), F.get(parts, F.lit(0)).alias("family"), F.get(parts, F.lit(1)).alias("hash"))


def read_suffix_list(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, section, comment) of a public-suffix file: one file of bounded size, whose lines depend on those before them."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    before = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.last(F.when(F.col("line").rlike("===BEGIN "), F.lower(F.regexp_extract("line", "===BEGIN (\\w+)", 1))), ignorenulls=True).over(before))
    marked = marked.withColumn("comment", F.last(F.when(F.col("line").startswith("//"), F.trim(F.regexp_replace("line", "^//", ""))), ignorenulls=True).over(before))
    return marked.filter((F.col("line") != "") & ~F.col("line").startswith("//")).select(F.col("line").alias("suffix"), "section", "comment")


class _Tables(HTMLParser):
    def __init__(self, wanted: str | None):
        super().__init__()
        self.wanted, self.rows, self.row, self.cell, self.depth = wanted, [], None, None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "table" and (self.depth or self.wanted is None or dict(attrs).get("id") == self.wanted):
            self.depth += 1
        elif self.depth and tag == "tr":
            self.row = []
        elif self.depth and tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.depth:
            self.depth -= 1


class HtmlTable:
    """Rows of a page's tables, or of that with an id."""

    def eval(self, html: str, table_id: str):
        parser = _Tables(table_id)
        parser.feed(html or "")
        for i, cells in enumerate(parser.rows):
            yield i, cells


def html_table() -> UserDefinedTableFunction:
    return F.udtf(HtmlTable, returnType="row int, cells array<string>")


def write_objects(df: DataFrame, path: str) -> None:
    """Writes objects (name, data) with the SHA-256 of their bytes."""
    df.withColumn("sha256", F.sha2("data", 256)).write.mode("overwrite").parquet(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects, each checked against its digest; a damaged one fails the read."""
    df = spark.read.parquet(path)
    return df.withColumn("data", F.when(F.sha2("data", 256) == F.col("sha256"), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("damaged object "), F.col("name"))).cast("binary")))


def flattened(spark: SparkSession, path: str, levels: int) -> DataFrame:
    """CSV files whose first `levels` rows are header rows, as columns named by their parts joined by _. See sources/headed.py."""
    return read_headed(spark, path, levels)
