"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: [\x20\x09-\x0D]
WHITE = " \t\n\x0b\x0c\r"
#: Rows of a key above which they are dealt among copies of what they are joined to, and the number of such keys at most.
SPREAD_ROWS, SPREAD_KEYS = 1000, 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def words_of(column: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased."""
    return F.filter(F.split(lower_ascii(text_of(column)), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """For each name one that df has no column of, for columns that are added for a while."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but for those that new ones of these names replace."""
    return [c for c in df.columns if c.lower() not in names]


_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a single machine without that setting, one of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-nxtide-")
    return _own_folder[app]


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/nxtide-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)  # what is not there can't be marked
    system.deleteOnExit(place)
    return path


def save(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nxtide_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what save() wrote, once nothing reads it any more."""
    path = getattr(df, "_nxtide_path", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], count: str, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined to table (a row for each of the keys, without nulls), with keys of very many rows dealt among copies of theirs.

    count: a column of table with the number of rows that have the key, or about that; by: columns
    that tell those rows apart. A key has a copy for each `limit` rows. Only keys with more are
    broadcast: they are SPREAD_KEYS at most, as their rows add up to no more than all.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    limit = max(SPREAD_ROWS, total // SPREAD_KEYS)
    copies, salt = free_names(rows, "copies", "salt")
    many = F.ceil(F.col(count) / limit).cast("int")
    hot = table.filter(F.col(count) > limit).select(*keys, many.alias(copies))
    if total <= limit or hot.isEmpty():
        return rows.join(table, keys, how)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(salt, F.pmod(F.xxhash64(*by), F.coalesce(copies, F.lit(1))).cast("int")).drop(copies)
    spread = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1)))
    return dealt.join(spread, [*keys, salt], how).drop(salt)


def sided(df: DataFrame, most: int) -> DataFrame:
    """df, with a broadcast hint if it is counted to have at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(lengths, most: int):
    """Ranges (start, end) over consecutive items whose lengths add up to at most `most`, or of one item."""
    start, total, lengths = 0, 0, list(lengths)
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)
