"""What the reports' users ask for: summaries, captures, messages, and views of messages by packet type and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nxtide.functions.packets import PACKETS, packet_predicate
from nxtide.operators.messages import with_first_seen

SCOPES = {"all": None, "global": ("dn_id",), "pcap": ("pcap_id", "dn_id")}


def packet_view(messages: DataFrame, packet: str, scope: str) -> DataFrame:
    """Messages of a packet type: all of them, or the first ones for a name, or for a name in a capture."""
    own = messages.filter(packet_predicate(packet))
    keys = SCOPES[scope]
    return own if keys is None else with_first_seen(own, keys).filter("rn = 1").drop("rn", "rn_qr", "rn_qr_rcode")


def refresh_views(messages: DataFrame, prefix: str, packets: tuple = PACKETS, scopes: tuple = ("global", "pcap")) -> list[str]:
    """Writes the views as tables again and returns their names."""
    names = []
    for packet in packets:
        for scope in scopes:
            packet_view(messages, packet, scope).write.mode("overwrite").saveAsTable(name := f"{prefix}_{packet}_{scope}")
            names.append(name)
    return names


def summary(messages: DataFrame) -> DataFrame:
    """One row with the count of each packet type and scope, from two aggregations."""
    counts = [F.count_if(packet_predicate(p)).alias(f"{p}_all") for p in PACKETS]
    flags = lambda keys: messages.groupBy(*keys).agg(*(F.bool_or(packet_predicate(p)).alias(p) for p in PACKETS))
    out = messages.agg(*counts)
    for scope in ("global", "pcap"):
        out = out.crossJoin(flags(SCOPES[scope]).agg(*(F.count_if(p).alias(f"{p}_{scope}") for p in PACKETS)))
    return out


def first_messages(messages: DataFrame, pcap_id: int, n: int) -> DataFrame:
    return messages.filter(F.col("pcap_id") == pcap_id).orderBy("time_s", "id").limit(n)


def select_captures(captures: DataFrame, text: str = "", where: Column | None = None, order: str = "pcap_id", page: int = 0, size: int = 50) -> DataFrame:
    """A page of the captures that hold a text in any column."""
    found = captures.filter(F.contains(F.lower(F.concat_ws(" ", *captures.columns)), F.lit(text.lower())))
    return (found if where is None else found.filter(where)).orderBy(order).offset(page * size).limit(size)


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def reset(spark: SparkSession, table: str) -> None:
    """Empties a table and keeps its schema."""
    empty = spark.table(table).schema
    spark.createDataFrame([], empty).write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table of text; of a larger one, its first `most` rows and a line that says so."""
    rows = df.limit(most + 1).collect()
    lines = [df.columns, ["-"] * len(df.columns), *([("" if v is None else str(v)) for v in r] for r in rows[:most])]
    return "\n".join([*(f"| {' | '.join(x)} |" for x in lines), *([f"(only the first {most} rows)"] if len(rows) > most else [])])


def repaired(data: Column) -> Column:
    """The text in bytes, without those that are no UTF-8. What stood for such a byte before is dropped too."""
    return F.translate(F.make_valid_utf8(data.cast("string")), "\ufffd", "")


def read_jdbc(spark: SparkSession, url: str, query: str, fetch: int = 100_000, **options: str) -> DataFrame:
    """A database's query, read in batches; with partitionColumn, lowerBound, upperBound and numPartitions by several tasks."""
    return spark.read.format("jdbc").options(url=url, fetchsize=str(fetch), **({"dbtable": f"({query}) q"} if "partitionColumn" in options else {"query": query}), **options).load()


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON value each, over several lines; of a list, each item is a row. Spark reads no further value of a file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def file_list(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of files; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
