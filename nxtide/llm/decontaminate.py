"""Benchmark decontamination by SimHash windows of an item's size, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nxtide.llm.common import join_spread, save, sided, text_of, words_of
from nxtide.llm.simhash import balls, segment_value, segments_of

SHINGLE, RADIUS, SEGMENTS, SIMILARITY = 5, 23, 6, 0.8
#: Rows of the benchmark's side of a join up to which it is broadcast (some 100 bytes a row); beyond, the join shuffles.
BROADCAST_ROWS = 500_000

#: Majority bits of an array of hashes `hs`. Never null, so that no test for null is pushed down to be made for each word.
SIMHASH = "coalesce(aggregate(sequence(0, 63), 0L, (a, j) -> a | if(2 * aggregate(hs, 0L, (s, h) -> s + (shiftrightunsigned(h, j) & 1L)) > size(hs), shiftleft(1L, j), 0L)), 0L)"
#: Sums of the lesser and greater weights that two arrays of shingles give each of their shingles; the weight is how often one occurs.
WEIGHTED = """aggregate(
    transform(array_union(hs, item_hs), x -> struct(size(filter(hs, y -> y = x)) as u, size(filter(item_hs, y -> y = x)) as v)),
    struct(0 as l, 0 as g),
    (a, c) -> struct(a.l + least(c.u, c.v) as l, a.g + greatest(c.u, c.v) as g),
    a -> a.l / a.g)"""


def hashed_shingles(words: str, width: int) -> str:
    """SQL: XXH64 of the words of each shingle of `width` words; an empty array where there are fewer."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(width))
    return f"if(size({words}) < {width}, array(), transform(sequence(0, size({words}) - {width}), i -> xxhash64({parts})))"


def leaks(docs: DataFrame, items: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, similarity: float = SIMILARITY, send_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, distance, similarity): the best window of a document for each item that it holds.

    docs: (doc_id, text); items: (item_id, text). A window is as long as an item has words
    (all of the text, if that is shorter), and starts at any word. An exact join on shingles thins out the windows before their fingerprints
    are made: bags of a and b shingles with similarity s have at least s / (1 + s) * (a + b) in common, so that
    only windows are left in which so many places have a shingle of some item of that length, in whatever order. None that
    reaches the similarity is lost by that. A window's fingerprint meets those of items in an index of `segments` blocks of bits. The items'
    side lists each value within radius // segments bits of its own for a block, so
    that by the pigeonhole principle every item within the radius is found, whatever its length.
    The exact similarity is that of the two bags of shingles: the sum of lesser over the sum
    of greater counts. An item of fewer than SHINGLE words has one shingle of all its words.
    Of several windows as similar the nearest fingerprint, then the first counts.

    The benchmark's side of each join is broadcast if counted to have at most `send_rows` rows. Where its
    shingles have more, the documents' shingles are shuffled, each with its place only, and those that very many
    places have are dealt among tasks. Windows are cut from the texts of the documents that have any, which are
    hashed once more. Null texts are empty; a text or item without words has no windows. Texts
    are read whole, however long. Rows repeated are one document; null ids are ids like others. Without
    documents or items there are no rows; further columns are not read.
    """
    named = items.select("item_id", words_of(F.col("text")).alias("iw")).filter("size(iw) > 0").withColumn("n_item", F.size("iw")).withColumn("width", F.least("n_item", F.lit(SHINGLE)))
    widths = sorted(r[0] for r in named.select("width").distinct().collect())  # five at most
    if not widths:
        return docs.sparkSession.createDataFrame([], docs.select("doc_id").schema.add(items.schema["item_id"]).add("start_word", "integer").add("n_words", "integer").add("distance", "integer").add("similarity", "double"))
    texts = docs.select("doc_id", F.xxhash64(text_of(F.col("text"))).alias("text_id"), words_of(F.col("text")).alias("ws"))
    windows, wanted = [], []
    for width in widths:
        own = named.filter(F.col("width") == width).withColumn("item_hs", F.expr(hashed_shingles("iw", width)))
        wanted.append(own)
        marks = own.select("n_item", F.explode("item_hs").alias("h")).distinct()
        hashed = texts.select("doc_id", "text_id", F.size("ws").alias("n_words"), F.expr(hashed_shingles("ws", width)).alias("all_hs"))
        # outer: else a filter on the array's size would be pushed down and make the array once for each of its elements
        shingles = hashed.select("doc_id", "text_id", "n_words", F.posexplode_outer("all_hs").alias("pos", "h"))
        if marks.limit(send_rows + 1).count() <= send_rows:
            found = shingles.join(F.broadcast(marks), "h")
        else:
            lists = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("hits")).join(marks.groupBy("h").agg(F.collect_list("n_item").alias("lengths")), "h")
            found = join_spread(shingles, save(lists), ["h"], "hits", ["doc_id", "text_id", "pos"]).withColumn("n_item", F.explode("lengths"))
        held = found.groupBy("doc_id", "text_id", "n_words", "n_item").agg(F.sort_array(F.collect_set("pos")).alias("ps"))
        size, all_ = F.least("n_words", "n_item") - (width - 1), F.col("n_item") - (width - 1)
        held = held.withColumn("size", size).withColumn("need", F.greatest(F.ceil((size + all_) * (similarity / (1 + similarity)) - 1e-9), F.lit(1)).cast("int")).filter("size(ps) >= need")
        # a window has `need` places if it reaches from the last of so many in a row back to the first
        spans = "transform(sequence(0, size(ps) - need), i -> struct(greatest(0, ps[i + need - 1] - size + 1) as a, least(ps[i], greatest(0, n_words - n_item)) as b))"
        starts = held.select("doc_id", "text_id", "n_item", F.explode(F.array_distinct(F.flatten(F.expr(f"transform(filter({spans}, x -> x.a <= x.b), x -> sequence(x.a, x.b))")))).alias("start_word"))
        starts = save(starts)
        few = starts.limit(send_rows + 1).count() <= send_rows
        by_doc = starts.groupBy(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text")).agg(F.collect_list(F.struct("n_item", "start_word")).alias("cuts"))
        cut = texts.join(F.broadcast(by_doc) if few else by_doc, F.expr("doc_id <=> _id and text_id = _text"))
        cut = cut.select("doc_id", F.size("ws").alias("n_words"), F.expr(hashed_shingles("ws", width)).alias("all_hs"), "cuts")
        cut = cut.select("doc_id", "n_words", "all_hs", F.explode("cuts").alias("c")).select("doc_id", "all_hs", F.col("c.start_word").alias("start_word"), F.least("n_words", "c.n_item").alias("n_words"), F.lit(width).alias("width"))
        windows.append(cut.select("doc_id", "start_word", "n_words", "width", F.expr(f"slice(all_hs, start_word + 1, n_words - {width - 1})").alias("hs")))
    window, item = windows[0], wanted[0]
    for w, i in zip(windows[1:], wanted[1:]):
        window, item = window.unionByName(w), item.unionByName(i)
    window = window.distinct().withColumn("fp", F.expr(SIMHASH))
    item = item.select("item_id", "width", "item_hs", F.expr(SIMHASH.replace("hs", "item_hs")).alias("item_fp"))
    blocks = list(enumerate(segments_of(64, segments)))
    kept = [f"({i}L << 40) | ({segment_value('fp', o, w)})" for i, (o, w) in blocks]
    listed = ", ".join(f"transform(array({','.join(f'{m}L' for m in balls(w, radius // segments))}), m -> ({i}L << 40) | (({segment_value('item_fp', o, w)}) ^ m))" for i, (o, w) in blocks)
    index = sided(item.select("item_id", "width", "item_fp", F.explode(F.expr(f"concat({listed})")).alias("key")), send_rows)
    near = window.withColumn("key", F.explode(F.array(*map(F.expr, kept)))).join(index, ["key", "width"]).filter(f"bit_count(fp ^ item_fp) <= {radius}")
    pairs = near.select("doc_id", "start_word", "n_words", "hs", "item_id", "width", F.expr("bit_count(fp ^ item_fp)").alias("distance")).distinct()
    checked = pairs.join(sided(item.select(F.col("item_id").alias("_id"), F.col("width").alias("_width"), "item_hs").distinct(), send_rows), F.expr("item_id <=> _id and width = _width")).withColumn("similarity", F.expr(WEIGHTED)).filter(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("start_word", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("distance"), -F.col("start_word")))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
