"""The trie of what conversations begin with: rolling fingerprints of prefixes, verified turn by turn, and what subtrees add up to."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nxtide.llm.common import join_spread, save, sided, text_of

#: Turns of one scan; longer conversations are scanned in several blocks, which then add up.
BLOCK = 4096
#: The two moduli and bases of the polynomial.
MODULI, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 912_931_001)
#: Conversation ids hashed at once: those that are equal but for so many low bits.
CHUNK_BITS = 12
#: Carries and collisions up to this many rows are broadcast.
BROADCAST_ROWS = 100_000


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, sha, n_bytes) of turns: the SHA-256 of role and text, and the bytes of the text. Rows without a conv_id belong to no conversation."""
    role, text = text_of(F.col("role")), text_of(F.col("text"))
    sha = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", sha.alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows of hashed() with their place `depth` in the conversation, from 1: by turn (null first), ties by their SHA-256.

    Ranges of (conversation, turn) are dealt to the tasks and numbered, each from where the ranges before it
    end, so that no task orders a whole long conversation; repeated rows are told apart by their place in the table.
    """
    order = ["turn", "sha", "tie"]
    told = save(rows).withColumn("tie", F.monotonically_increasing_id())
    ranges = save(told.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("conv_id", "range").count().withColumn("start", F.sum("count").over(before)).filter("start > 0").drop("count")
    local = F.row_number().over(Window.partitionBy("range", "conv_id").orderBy(*order))
    # a conversation goes on in a range only if it is its first one: there are no more starts than ranges
    found = ranges.withColumn("local", local).join(F.broadcast(starts), ["conv_id", "range"], "left")
    return found.select("conv_id", (F.coalesce("start", F.lit(0)) + F.col("local")).alias("depth"), "sha", "n_bytes")


def rebuilt(rows: DataFrame, family: int = 5, shared: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation begins with the first h turns of the family's head in place of its own first h.

    rows: as ranked() gives them. h is the CRC-32 of the decimal id modulo `shared`; the head of c is c - c % family. A head has
    at most shared - 1 turns to give, to fewer than 2 * family conversations. Conversations may end up without turns.
    """
    own_h = F.crc32(F.col("conv_id").cast("string")) % shared
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("length"))
    heads = lengths.select(F.col("conv_id").alias("head"), F.col("length").alias("head_length"))
    plan = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("head"), own_h.alias("h")).join(heads, "head", "left")
    plan = plan.select("conv_id", "head", "h", F.least("h", F.coalesce("head_length", F.lit(0))).alias("given"))
    plan = save(plan)
    given = rows.filter(F.col("depth") < shared).withColumnRenamed("conv_id", "head").join(plan, "head").filter(F.col("depth") <= F.col("given"))
    rest = rows.filter(F.col("depth") > own_h).join(plan, "conv_id").withColumn("depth", F.col("depth") - F.col("h") + F.col("given"))
    return given.select("conv_id", "depth", "sha", "n_bytes").unionByName(rest.select("conv_id", "depth", "sha", "n_bytes")), plan.select("conv_id")


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1)."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, modulus)) % np.uint64(modulus)
        done += more
    return out


def segmented(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that begin anew where `first` is set."""
    total = np.cumsum(values)
    starts = np.flatnonzero(first)
    before = np.zeros(len(starts), values.dtype)
    before[starts > 0] = total[starts[starts > 0] - 1]
    return total - np.repeat(before, np.diff(np.append(starts, len(values))))


def scanner(block_size: int, moduli: tuple):
    """A scan over rows in order of (conv_id, block, depth) that adds up polynomial terms and bytes within each block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [powers(b, m, block_size) for b, m in zip(BASES, moduli)]
        last, carry = None, [0, 0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, block, depth, n_bytes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "block", "depth", "n_bytes"))
            value = batch.column("value").to_numpy(zero_copy_only=False).view(np.uint64)
            first = np.append(True, (conv[1:] != conv[:-1]) | (block[1:] != block[:-1]))
            goes_on = last == (conv[0], block[0])
            place, blocks = ((depth - 1) % block_size).astype(np.int64), np.unique(block, return_inverse=True)
            sums = []
            for k, m in enumerate(moduli):
                ahead = np.array([pow(BASES[k], int(b) * block_size, m) for b in blocks[0]], np.uint64)[blocks[1]]
                terms = (value % np.uint64(m) + np.uint64(1)) % np.uint64(m) * tables[k][place] % np.uint64(m) * ahead % np.uint64(m)
                sums.append(segmented(terms, first))
            sums.append(segmented(n_bytes, first))
            if goes_on:
                upto = np.flatnonzero(first)[1] if first.sum() > 1 else len(conv)
                for k in range(3):
                    sums[k][:upto] += sums[k].dtype.type(carry[k])
            sums[:2] = [s % np.uint64(m) for s, m in zip(sums, moduli)]
            last, carry = (conv[-1], block[-1]), [int(s[-1]) for s in sums]
            prefix = (sums[0] << np.uint64(31) | sums[1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "block", "depth", "sha", "n_bytes")), pa.array(prefix), pa.array(sums[2].astype(np.int64))],
                ["conv_id", "block", "depth", "sha", "n_bytes", "prefix", "bytes_to"],
            )

    return scan


def fingerprinted(turns: DataFrame, block_size: int = BLOCK, moduli: tuple = MODULI) -> DataFrame:
    """turns with `prefix`, the fingerprint of all turns of the conversation up to this one, and `bytes_to`, the bytes of their texts."""
    rows = turns.select("conv_id", F.floor((F.col("depth") - 1) / block_size).alias("block"), F.col("depth").cast("long").alias("depth"), "sha", "n_bytes", F.xxhash64("sha").alias("value"))
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    rows = save(rows.mapInArrow(scanner(block_size, moduli), "conv_id long, block long, depth long, sha binary, n_bytes long, prefix long, bytes_to long"))
    full = rows.filter(F.col("depth") % block_size == 0)  # whatever goes on after a block has filled it
    if not full.isEmpty():
        upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        high, low = F.shiftright("prefix", 31), F.col("prefix").bitwiseAND(2**31 - 1)
        carry = full.select("conv_id", (F.col("block") + 1).alias("block"), *(F.sum(c).over(upto).alias(a) for c, a in ((high, "c1"), (low, "c2"), (F.col("bytes_to"), "c3"))))
        found, none = rows.join(sided(save(carry), BROADCAST_ROWS), ["conv_id", "block"], "left"), F.lit(0).cast("long")
        one, two = (high + F.coalesce("c1", none)) % moduli[0], (low + F.coalesce("c2", none)) % moduli[1]
        rows = found.withColumn("prefix", F.shiftleft(one, 31).bitwiseOR(two)).withColumn("bytes_to", F.col("bytes_to") + F.coalesce("c3", none))
    return rows.select("conv_id", "depth", "sha", "n_bytes", "prefix", "bytes_to")


KEY = ["depth", "prefix", "twin"]


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows with `twin`, which tells prefixes with the same fingerprint apart, and a row for each node.

    In a group of one depth and fingerprint each member's last turn is held against that of the representative, the smallest
    conv_id: the least and the greatest SHA-256 must be the same. If they are, the members' prefixes without that turn
    share a fingerprint too, which is verified one level up, and so on up to the root. Where they are not, members
    differ by the turns in such groups on their way: those turns make up `twin`, here and for all that goes on from here.
    """
    rows = rows.withColumn("twin", F.lit(""))
    counted = (F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("rep"))
    groups = save(rows.groupBy(KEY).agg(*counted, F.min("sha").alias("least"), F.max("sha").alias("greatest")))
    mixed = groups.filter("least <> greatest").select("depth", "prefix", F.lit(True).alias("mixed"))
    if mixed.isEmpty():
        return rows, groups.select(*KEY, "n_convs", "rep")
    way = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    marks = F.collect_list(F.when(F.col("mixed"), F.hex("sha"))).over(way)
    told = rows.join(sided(mixed, BROADCAST_ROWS), ["depth", "prefix"], "left")
    rows = save(told.withColumn("twin", F.when(F.size(marks) > 0, F.sha2(F.array_join(marks, ""), 256)).otherwise("")).drop("mixed"))
    return rows, save(rows.groupBy(KEY).agg(*counted))


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's comma-joined ids, which come in chunks in order; a node's digest is carried from chunk to chunk."""
    node, digest = None, None
    names = ["rep", "length", "ends_sha256"]
    for batch in batches:
        out = []
        for rep, length, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "length", "ids"))):
            if node != (rep, length):
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (rep, length), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names)


def prefix_trie(turns: DataFrame, conversations: DataFrame, block_size: int = BLOCK, moduli: tuple = MODULI) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node: each distinct sequence of first turns, from the root.

    turns: (conv_id, depth from 1 without gaps, sha, n_bytes); conversations: all conv_ids, those without turns too. A node is named by the smallest
    conv_id of its members and its depth. saved_tokens counts, over a node's subtree, what its nodes' members share: bytes of the node's
    last text for each member but one. Prefixes are told apart by the SHA-256 of their turns, not by fingerprints alone.

    A conversation names the nodes on its way from some depth on, as there it is the smallest member left; so each node below its parent is
    rolled up by the conversation that names it: a member adds to a node 1 for each child and leaf that it names, and the bytes of what it
    shares on. Every conversation adds to the nodes on its way only, in one pass for any depth. A node of very many members is dealt among tasks,
    and a conversation of very many turns among blocks. Only the digest of a node's own ids is made in one task,
    chunk by chunk in bounded memory, as SHA-256 has to be. No conversations give no nodes.
    """
    spark_long = lambda value: F.lit(value).cast("long")
    roots = conversations.select("conv_id", spark_long(0).alias("depth"), F.lit(b"").alias("sha"), *(spark_long(0).alias(c) for c in ("n_bytes", "prefix", "bytes_to")))
    rows, groups = verified(save(fingerprinted(turns, block_size, moduli).unionByName(roots)))
    ways = save(join_spread(rows.drop("sha"), groups, KEY, "n_convs", ["conv_id"]).drop("prefix", "twin"))

    other = F.col("rep") != F.col("conv_id")
    by_conv = save(ways.groupBy("conv_id").agg(
        F.max("depth").alias("length"), F.min(F.when(~other, F.col("depth"))).alias("own"), F.max(F.when(other, F.col("bytes_to"))).alias("shared"),
        F.max_by(F.when(other, F.col("rep")), F.when(other, F.col("depth"))).alias("above"), F.max_by("rep", "depth").alias("last_rep"), F.max_by("n_convs", "depth").alias("last_n"),
    ))
    by_conv = by_conv.withColumn("own", F.coalesce("own", F.col("length") + 1))
    leaves = by_conv.groupBy(F.col("last_rep").alias("conv_id"), "length").agg(F.count(F.lit(1)).alias("n"), F.max("last_n").alias("last_n")).filter("n = last_n").select("conv_id", F.lit(1).alias("leaf"))
    told = ways.join(save(by_conv.join(leaves, "conv_id", "left")).drop("last_rep", "last_n"), "conv_id")
    depth, own, here = F.col("depth"), F.col("own"), F.col("conv_id")
    nodes = told.groupBy(F.col("rep").alias("named"), "depth").agg(
        F.max(F.when(other | (depth == 0), None).when(depth > own, here).otherwise(F.col("above"))).alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"), F.count_if((depth >= own - 1) & (depth < F.col("length"))).alias("n_children"), F.count("leaf").alias("n_leaves"),
        F.sum(F.when(depth < own, F.col("shared") - F.col("bytes_to") + F.col("n_bytes")).otherwise(0)).alias("saved_tokens"),
    )
    chunks = by_conv.groupBy(F.col("last_rep").alias("rep"), "length", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = chunks.repartition("rep", "length").sortWithinPartitions("rep", "length", "chunk").mapInArrow(digests, "rep long, length long, ends_sha256 string")
    found = nodes.join(ends.withColumnsRenamed({"rep": "named", "length": "depth"}), ["named", "depth"], "left")
    return found.select(
        F.col("named").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
