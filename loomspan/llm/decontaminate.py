"""Benchmark decontamination: documents that hold an item of a benchmark, or nearly.

Windows of an item's own length are cut from the documents where a five-word
shingle of the item aligns them (a window that shares no shingle has similarity
0).  A window's SimHash, over its words, meets those of all items of that length
through a multi-index of one block more than the radius, which finds every fingerprint within it: RADIUS bits, and
LONG_RADIUS in items of over LONG words, where as similar windows differ in more bits; candidates are then verified by the exact weighted similarity of their shingle
bags: the sum over shingles of the lesser count, over that of the greater, is at
least 0.75.  Only DataFrame functions are used.

Words are lower-cased runs of other characters than white space.  A document that
is shorter than an item is one window.  Items without five words have no shingle
and are not searched for; null texts have no words; rows without a doc_id or an
item_id cannot be named and take no part.  Repeated rows give one result.  Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .scratch import Table

WORDS = 5
NUM, DEN = 3, 4
#: Bits that fingerprints of an item and a window may differ in, and the blocks that find all such.
RADIUS, LONG_RADIUS, LONG = 14, 22, 60
#: Benchmark rows (shingles, blocks) up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 400_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), "")


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of five words, in order."""
    at = F.sequence(F.lit(0), F.size(words) - WORDS)
    return F.when(F.size(words) >= WORDS, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))) \
        .otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words, hamming): the nearest window of every document and item that it holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text").cast("string")).alias("w")) \
        .where("item_id is not null").where(F.size("w") >= WORDS).distinct()
    items = Table(items, "items").df
    items = items.withColumn("item", F.xxhash64("item_id", "w")).withColumn("len", F.size("w"))
    anchors = items.select("len", F.col("w").alias("iw"), F.posexplode(shingles_of(F.col("w"))).alias("q", "h")) \
        .select("h", "q", "len", F.xxhash64(F.get("iw", F.col("q") - 1)).alias("before")).distinct()
    rows = anchors.count()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text").cast("string")).alias("w")).where("doc_id is not null")
    # Of a position, a hash and the word before are enough; the words are joined back to the hits where they would be shuffled with every shingle.
    small = rows <= BROADCAST_ROWS
    placed = docs.select("doc_id", F.size("w").alias("n"), (F.col("w") if small else F.xxhash64("w")).alias("carried"), shingles_of(F.col("w")).alias("hs"),
                         *[] if small else [F.transform("w", lambda x: F.xxhash64(x)).alias("own")])
    entry = F.col("hs") if small else F.transform("hs", lambda h, i: F.struct(h.alias("h"), F.get("own", i - 1).alias("previous")))
    # the outer form, as Spark would else filter on the array below the projection that makes it, and make it twice
    found = placed.select("doc_id", "n", "carried", F.posexplode_outer(entry).alias("p", "h"))
    if small:
        found = found.join(F.broadcast(anchors), "h").withColumn("previous", F.xxhash64(F.get("carried", F.col("p") - 1)))
    else:
        found = found.select("doc_id", "n", "carried", "p", "h.*").join(anchors, "h")
    found = found \
        .where((F.col("q") == 0) | (F.col("p") == 0) | (F.col("previous") != F.col("before")))  # where a run of shared shingles begins
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("len")))
    found = found.select("doc_id", F.col("carried").alias("w"), "len", start.alias("start"))
    if not small:
        found = found.distinct().withColumnRenamed("w", "h").join(docs.withColumn("h", F.xxhash64("w")), ["doc_id", "h"])
    windows = found.select("doc_id", "len", "start", F.slice("w", F.col("start") + 1, F.col("len")).alias("ww")).distinct()
    windows = windows.withColumn("fp", simhash.of_words(F.col("ww"))).withColumn("window", F.xxhash64("doc_id", "start", "ww"))
    windows = Table(windows, "windows").df

    def indexed(df: DataFrame) -> DataFrame:
        fp = F.col("fp")
        return df.withColumn("key", F.explode(F.when(F.col("len") <= LONG, simhash.block_keys(fp, RADIUS + 1, 1)).otherwise(simhash.block_keys(fp, LONG_RADIUS + 1, 1))))

    own = items.select("item", "item_id", "len", "w", simhash.of_words(F.col("w")).alias("ifp"))
    index = indexed(own.select("item", "len", F.col("ifp").alias("fp"))).withColumnRenamed("fp", "ifp")
    pairs = indexed(windows.select("window", "len", "fp")).join(_small(index, rows), ["len", "key"]) \
        .where(simhash.distance(F.col("fp"), F.col("ifp")) <= F.when(F.col("len") <= LONG, RADIUS).otherwise(LONG_RADIUS)) \
        .select("window", "item", simhash.distance(F.col("fp"), F.col("ifp")).alias("hamming")).distinct()

    def bag(words: str) -> Column:
        return F.array_sort(shingles_of(F.col(words)))

    item_bags = own.select("item", "item_id", bag("w").alias("ib"))
    both = pairs.join(windows.select("window", "doc_id", "start", F.size("ww").alias("n_words"), bag("ww").alias("wb")), "window") \
        .join(_small(item_bags, rows), "item")
    # of equal shingles, the k-th of one side meets the k-th of the other: numbered, a bag is a set
    shared = F.size(F.array_intersect(_numbered("wb"), _numbered("ib")))
    scored = both.withColumn("shared", shared).withColumn("all", F.size("wb") + F.size("ib") - F.col("shared")) \
        .where(F.col("shared") * DEN >= F.col("all") * NUM)
    best = F.max_by(F.struct("start", "n_words", "hamming"), F.struct(F.col("shared") / F.col("all"), -F.col("hamming"), -F.col("start")))
    out = scored.groupBy("doc_id", "item_id").agg(F.max(F.col("shared") / F.col("all")).alias("similarity"), best.alias("b"))
    return out.select("doc_id", "item_id", "similarity", F.col("b.start").cast("long").alias("start"),
                      F.col("b.n_words").cast("long").alias("n_words"), F.col("b.hamming").cast("int").alias("hamming"))


def _numbered(column: str) -> Column:
    """Each element of a sorted array with its number among its equals."""
    bag = F.col(column)
    return F.transform(bag, lambda x, i: F.struct(x.alias("h"), (i - F.array_position(bag, x) + 1).alias("k")))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; rows without a doc_id stay."""
    return documents.join(contaminated(documents, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*documents.columns)
