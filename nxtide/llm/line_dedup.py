"""Reversible line deduplication: sharded cuckoo filters over exact tables of reference counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nxtide.llm.common import WHITE, free_names, join_spread, lower_ascii, new_path, save, text_of, without

#: Code points of a key, and documents that hold it, from which its lines are dropped.
MIN_CHARS, MIN_DOCS = 20, 3
#: Shards at least, and rows of the first insertion for each shard where there are more.
SHARDS, SHARD_ROWS = 64, 1 << 22
#: Bytes of all filters up to which tasks are sent them whole; beyond, lines are dealt to the filters' shards.
SEND_BYTES = 32 << 20
SALTS = 8


class Cuckoo:
    """A cuckoo filter of 16-bit tags in buckets of four, over 64-bit hashes. Its bytes are its state."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (cls.SLOTS * 0.8)))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def read(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    def write(self) -> bytes:
        return self.table.tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tags, and the two buckets that may hold each."""
        mask = np.uint64(len(self.table) - 1)
        h = hashes.astype(np.int64).view(np.uint64)
        tags = (h >> np.uint64(48)) | np.uint64(1)
        first = h & mask
        return tags.astype(np.uint16), first.astype(np.int64), (first ^ ((tags * np.uint64(0x5BD1E995)) & mask)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may have been added; true for each one that has."""
        tags, one, two = self.places(hashes)
        return ((self.table[one] == tags[:, None]) | (self.table[two] == tags[:, None])).any(axis=1)

    def add(self, hashes: np.ndarray) -> bool:
        """False if there is no room; the filter is then to be made again, larger."""
        tags, one, two = self.places(hashes)
        left = np.arange(len(tags))
        for at in (one, two):
            left = left[~self._put(tags[left], at[left])]
        mask, rng = len(self.table) - 1, np.random.default_rng(len(hashes))
        for tag, place in zip(tags[left].tolist(), two[left].tolist()):  # the few that find both buckets full
            for _ in range(self.KICKS):
                slot = int(rng.integers(self.SLOTS))
                tag, self.table[place, slot] = int(self.table[place, slot]), tag
                place ^= (tag * 0x5BD1E995) & mask
                if (free := np.flatnonzero(self.table[place] == 0)).size:
                    self.table[place, free[0]] = tag
                    break
            else:
                return False
        return True

    def _put(self, tags: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts tags into free slots of these buckets, as many as there are; whether each has one."""
        order = np.argsort(at, kind="stable")
        at = at[order]
        turn = np.arange(len(at)) - np.searchsorted(at, at)  # a tag's place among those of its bucket
        free = self.table[at] == 0
        slots = free & (free.cumsum(axis=1) == turn[:, None] + 1)
        put = slots.any(axis=1)
        self.table[at[put], slots.argmax(axis=1)[put]] = tags[order][put]
        out = np.empty(len(at), bool)
        out[order] = put
        return out

    def remove(self, hashes: np.ndarray) -> None:
        """Takes out one tag for each hash that has been added before."""
        for tag, one, two in zip(*(x.tolist() for x in self.places(hashes))):
            for place in (one, two):
                if (found := np.flatnonzero(self.table[place] == tag)).size:
                    self.table[place, found[0]] = 0
                    break


def line_key(line: Column) -> Column:
    return F.btrim(lower_ascii(line), F.lit(WHITE))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_id, pos, h1, h2) of each line whose key is long enough; h1 and h2 stand for the key, with 128 bits."""
    text = text_of(F.col("text"))
    # the hash comes before the lines, or else each line would carry its text along
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), F.split(text, "\n", -1).alias("lines")).filter("doc_id is not null")
    lines = split.select("doc_id", "text_id", F.posexplode_outer("lines").alias("pos", "line"))
    keyed = lines.select("doc_id", "text_id", "pos", line_key(F.col("line")).alias("k")).filter(F.length("k") >= min_chars)
    return keyed.select("doc_id", "text_id", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2"))


@dataclass(frozen=True)
class Sharded:
    """A table in the shared folder with a folder for each `shard`, of which a change reads and writes only some.

    versions: a path, the shards in it, and those of them that are valid. What is written stays as it is,
    so that an index before a change can still be read after it.
    """

    schema: str
    versions: tuple[tuple[str, frozenset[int], frozenset[int]], ...] = ()

    def read(self, spark: SparkSession, only: frozenset[int] | None = None) -> DataFrame:
        out = spark.createDataFrame([], self.schema)
        for path, held, valid in self.versions:
            wanted = valid if only is None else valid & only
            if wanted:
                rows = spark.read.schema(self.schema).parquet(path)
                out = out.unionByName(rows if wanted == held else rows.filter(F.col("shard").isin(sorted(wanted))))
        return out

    def put(self, rows: DataFrame, instead: frozenset[int] = frozenset()) -> Sharded:
        """With rows added; those that are there already in the shards `instead` are valid no more."""
        spark, path = rows.sparkSession, new_path(rows.sparkSession)
        dealt = spark.sql("SELECT /*+ REBALANCE(shard) */ * FROM {rows}", rows=rows)  # a large shard is several tasks
        dealt.write.mode("append").partitionBy("shard").parquet(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
        held = frozenset(int(n.partition("=")[2]) for n in names if n.startswith("shard="))
        before = tuple((p, h, v - instead) for p, h, v in self.versions if v - instead)
        return replace(self, versions=(*before, (path, held, held)) if held else before)

    def shards(self) -> frozenset[int]:
        return frozenset().union(*(v for _, _, v in self.versions))


def _values(df: DataFrame, column: str) -> frozenset[int]:
    """The values of a column that names shards: as many as there are shards at most."""
    return frozenset(r[0] for r in df.select(column).distinct().collect())


@dataclass(frozen=True)
class LineIndex:
    """An index of lines to which documents are added and from which they are deleted again.

    by_doc (shard, doc_id, h1, h2) and by_key (shard, h1, h2, doc_id): which documents hold a key, in
    shards by a hash of the document and of the key; counts (shard, h1, h2, refs, last): how many, and the
    largest; filters (shard, data): a cuckoo filter for each shard of keys, with those that at least
    min_docs documents hold. A filter says of a line that it is surely kept, or else the table of counts
    decides, so that no false positive has an effect. A key is two hashes, 128 bits, of its line:
    tables are exact but for lines that agree in both, of which 10^12 lines hold none with a chance of
    1 - 10^-14. Deletion lowers counts, and takes keys that fall below min_docs out of the filters: what an
    index then says is what one that never had those documents would say.

    Both read and write only the shards of the documents and keys that change. With shards = 0 the first
    insertion sets their number, by its rows.
    """

    spark: SparkSession
    by_doc: Sharded = Sharded("shard int, doc_id long, h1 long, h2 long")
    by_key: Sharded = Sharded("shard int, h1 long, h2 long, doc_id long")
    counts: Sharded = Sharded("shard int, h1 long, h2 long, refs long, last long")
    filters: Sharded = Sharded("shard int, data binary")
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    shards: int = 0
    send_bytes: int = SEND_BYTES

    @classmethod
    def empty(cls, spark: SparkSession, **parameters) -> LineIndex:
        return cls(spark, **parameters)

    @property
    def refs(self) -> DataFrame:
        return self.counts.read(self.spark)

    def _of_doc(self) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit("doc")), F.lit(self.shards)).cast("int")

    def _of_key(self) -> Column:
        return F.pmod(F.xxhash64("h2", "h1"), F.lit(self.shards)).cast("int")

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents (doc_id, text) added. A doc_id that the index knows gains the keys that are new to it; rows with a null one are left out."""
        new = lines_of(docs, self.min_chars).select("doc_id", "h1", "h2").distinct()
        if self.by_doc.versions:
            ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
            known = self.by_doc.read(self.spark, _values(ids.select(self._of_doc().alias("s")), "s")).join(ids, "doc_id", "left_semi")
            new = new.join(known.drop("shard"), ["doc_id", "h1", "h2"], "left_anti")
        new = save(new)
        own = self if self.shards else replace(self, shards=max(SHARDS, -(-new.count() // SHARD_ROWS)))
        keyed = new.withColumn("shard", own._of_key())
        by_doc = own.by_doc.put(new.withColumn("shard", own._of_doc()).select("shard", "doc_id", "h1", "h2"))
        by_key = own.by_key.put(keyed.select("shard", "h1", "h2", "doc_id"))
        more = keyed.groupBy("shard", "h1", "h2").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("last"))
        touched = _values(keyed, "shard")
        both = own.counts.read(self.spark, touched).unionByName(more)
        return own._counted(touched, both.groupBy("shard", "h1", "h2").agg(F.sum("refs").alias("refs"), F.max("last").alias("last")), by_doc, by_key)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of ids (doc_id); those that the index does not know change nothing."""
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
        if not self.by_doc.versions:
            return self
        places = _values(ids.select(self._of_doc().alias("s")), "s")
        held = self.by_doc.read(self.spark, places)
        gone = save(held.join(ids, "doc_id", "left_semi").withColumn("shard", self._of_key()))
        touched = _values(gone, "shard")
        by_key = self.by_key.put(self.by_key.read(self.spark, touched).join(gone.drop("shard"), ["h1", "h2", "doc_id"], "left_anti"), touched)
        keys = gone.select("shard", "h1", "h2").distinct()
        again = by_key.read(self.spark, touched).join(keys, ["shard", "h1", "h2"], "left_semi").groupBy("shard", "h1", "h2").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("last"))
        same = self.counts.read(self.spark, touched).join(keys, ["shard", "h1", "h2"], "left_anti")
        return self._counted(touched, same.unionByName(again), self.by_doc.put(held.join(ids, "doc_id", "left_anti"), places), by_key)

    def _counted(self, touched: frozenset[int], counts: DataFrame, by_doc: Sharded, by_key: Sharded) -> LineIndex:
        """With these counts in the place of those of the shards, and the shards' filters brought in line with them."""
        key = ["shard", "h1", "h2"]
        table = self.counts.put(counts, touched)
        often = F.col("refs") >= self.min_docs
        was, now = (t.read(self.spark, touched).filter(often).select(*key) for t in (self.counts, table))
        changes = now.join(was, key, "left_anti").withColumn("step", F.lit(1)).unionByName(was.join(now, key, "left_anti").withColumn("step", F.lit(-1)))

        def update(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            shard = int((filters if len(filters) else keys)["shard"].iloc[0])
            added, gone = (keys["h1"].to_numpy(np.int64)[keys["step"].to_numpy() == s] for s in (1, -1))
            held = Cuckoo.read(filters["data"].iloc[0]) if len(filters) else Cuckoo.sized(len(added))
            held.remove(gone)
            return pd.DataFrame({"shard": [shard], "data": [held.write() if held.add(added) else None]})

        filters = save(self.filters.read(self.spark, touched).groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(update, "shard int, data binary"))
        full = filters.filter("data is null").select("shard")

        def remake(keys: pd.DataFrame) -> pd.DataFrame:
            h, n = keys["h1"].to_numpy(np.int64), len(keys)
            while not (made := Cuckoo.sized(n)).add(h):
                n *= 2
            return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "data": [made.write()]})

        if not full.isEmpty():
            again = now.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(remake, "shard int, data binary")
            filters = filters.filter("data is not null").unionByName(again)
        return replace(self, by_doc=by_doc, by_key=by_key, counts=table, filters=self.filters.put(filters, touched))

    def _maybe_dropped(self, lines: DataFrame) -> DataFrame:
        """The lines that the filters don't rule out."""
        lines, filters = lines.withColumn("shard", self._of_key()), self.filters.read(self.spark)
        size = filters.agg(F.sum(F.length("data"))).first()[0] or 0
        if size <= self.send_bytes:
            sent = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in filters.collect()})

            def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                filters = {s: Cuckoo.read(data) for s, data in sent.value.items()}
                for f in frames:
                    shards, hashes = f["shard"].to_numpy(), f["h1"].to_numpy(np.int64)
                    out = np.zeros(len(f), bool)
                    for s in np.unique(shards).tolist():
                        if s in filters:
                            at = shards == s
                            out[at] = filters[s].holds(hashes[at])
                    yield f[out].drop(columns="shard")

            # not a UDF in a filter: that would be pushed down to where rows still have their lines
            return lines.mapInPandas(held, ", ".join(f"{c} {t}" for c, t in lines.drop("shard").dtypes))
        # each filter goes ahead of the lines of its shard and salt; with zeros, as nulls would make the hashes floats
        kinds = dict(lines.dtypes)
        ahead = filters.select(*(F.lit(0).cast(t).alias(c) for c, t in kinds.items() if c != "shard"), "shard", "data", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        both = lines.withColumn("data", F.lit(None).cast("binary")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).unionByName(ahead)
        dealt = both.repartition(self.shards * SALTS, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("data").isNull())

        def pass_by(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, at = None, None
            for f in frames:
                for place, part in f.groupby(["shard", "salt"], sort=False):
                    if place != at:
                        held, at = None, place
                    for data in part["data"].dropna():
                        held = Cuckoo.read(data)
                    rows = part[part["data"].isna()]
                    if held is not None and len(rows):
                        yield rows[held.holds(rows["h1"].to_numpy(np.int64))][list(kinds)]

        return dealt.mapInPandas(pass_by, ", ".join(f"{c} {t}" for c, t in kinds.items())).drop("shard")

    def drops(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text_id, dropped): the positions of lines to drop from each text, if any."""
        if not self.shards:
            return self.spark.createDataFrame([], "doc_id long, text_id long, dropped array<int>")
        often = self.refs.filter(F.col("refs") >= self.min_docs).select("h1", "h2", "last", "refs")
        maybe = self._maybe_dropped(lines_of(docs, self.min_chars))
        found = join_spread(maybe, often, ["h1", "h2"], "refs", ["doc_id", "pos"]).filter("doc_id <> last")
        return found.groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("dropped"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with `kept_text`, `n_lines` (before) and `n_dropped`.

        A null or empty text is one empty line. A key's lines go from all documents but the
        largest doc_id that holds it, whose lines all stay; a line that is in very many documents is dealt among
        copies of its count. Rows with the same doc_id are one document, repeated ones too; rows with a null
        doc_id are not counted and keep all lines. Texts are read whole, however long. An empty index drops
        nothing, and an empty table stays empty. Columns of docs with the names of new ones are replaced.
        """
        text = text_of(F.col("text"))
        doc, text_id, dropped, lines = free_names(docs, "doc", "text_id", "dropped", "lines")
        drops = self.drops(docs).select(F.col("doc_id").alias(doc), F.col("text_id").alias(text_id), F.col("dropped").alias(dropped))
        rows = docs.select(without(docs, "kept_text", "n_lines", "n_dropped"))
        rows = rows.join(drops, (rows["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(text_of(rows["text"])) == F.col(text_id)), "left")
        rows = rows.withColumn(lines, F.split(text, "\n", -1)).withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size(dropped), F.lit(0)).cast("long"))
        stay = F.expr(f"transform(array_except(sequence(0, size(`{lines}`) - 1), `{dropped}`), i -> `{lines}`[i])")
        return rows.withColumn("kept_text", F.when(F.col("n_dropped") > 0, F.array_join(stay, "\n")).otherwise(text)).drop(doc, text_id, dropped, lines)
