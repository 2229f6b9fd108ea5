"""Benchmark decontamination by a prefix-filtered set join, DataFrames only.

A window is ``size`` consecutive words of an item (an item of fewer words, but
not none, is one window).  Containment of a window asks for all of its
shingles, so one of them is the necessary prefix: the rarest, shingles being
ordered by the number of windows that hold them, then by hash.  Documents meet
windows in a join on that shingle; a window's length and the shingle's place
in it bound where it can lie in the document; the words that stand there are
then joined, whole, to the windows.

Shingles of documents pass a bitmap of the prefixes (512 kB, whatever the
benchmark's size) before they meet the prefix table, which Spark broadcasts or
shuffles by its measured size.  A prefix row tells a place and a length, not a
window: however many windows share a shingle, a document gathers each place
that one of them may take once, so no more than it has words.  Places go back
to their documents by a key of 128 bits, which copies share.

Defined cases: a null text has no words and is hit by nothing; an item without
words has no window; items of one text are all reported; a null item_id is
reported as the empty string; documents that repeat are judged each; an empty
benchmark or document table gives no hit or no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm._spark import ascii_lower, bitmap, in_bitmap, saved

WINDOW, SHINGLE = 10, 5
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, a-z and letters beyond ASCII, A-Z folded."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def _grams(words: Column, n: Column, size: Column | int) -> Column:
    """Hashes of the shingles of ``size`` words, in order."""
    size = F.lit(size) if isinstance(size, int) else size
    inner = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n >= size, inner).otherwise(F.array().cast("array<bigint>"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item, w, len, text: the different windows of each of ``items(item_id, text)``."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    words = words.withColumn("n", F.size("w")).where("n > 0")
    starts = F.when(F.col("n") >= size, F.sequence(F.lit(1), F.col("n") - size + 1)).otherwise(F.array(F.lit(1)))
    each = words.select("item", F.explode(starts).alias("at"), "w", F.least("n", F.lit(size)).alias("len"))
    each = each.select("item", F.slice("w", F.col("at"), F.col("len")).alias("w"), "len")
    return each.withColumn("text", F.array_join("w", " ")).distinct()


def prefixes(found: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """gram, hash, off, len: the rarest shingle of each window with its place there, once for all windows that agree in them."""
    each = found.select("w", "len", "text").distinct().withColumn("gram", F.least("len", F.lit(shingle)))
    grams = each.select("text", "len", "gram", F.posexplode(_grams(F.col("w"), F.col("len"), F.col("gram"))).alias("off", "hash"))
    common = grams.groupBy("gram", "hash").agg(F.count(F.lit(1)).alias("held"))
    ranked = grams.join(common, ["gram", "hash"])
    first = ranked.groupBy("text").agg(F.min_by(F.struct("gram", "hash", "off", "len"), F.struct("held", "hash", "off")).alias("p"))
    return first.select("p.gram", "p.hash", "p.off", "p.len").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """``docs`` (their own columns of these names replaced) with n_words, hits (word places, from 0, inside any window's
    occurrence, ascending) and items (ids of the items with such windows, sorted
    as strings)."""
    held = saved(windows(items, size))
    table = saved(prefixes(held, shingle))
    grams = [r["gram"] for r in table.select("gram").distinct().collect()]  # at most `shingle` numbers
    marks = [F.xxhash64(key, "text").alias("mark"), F.xxhash64(F.lit(1), key, "text").alias("mark2")]
    both = ["mark", "mark2"]
    read = docs.select(*marks, words_of(F.col("text")).alias("w"))
    read = read.withColumn("n", F.size("w")).where("n > 0")
    found = table.select(F.lit(0).cast("long").alias("mark"), F.lit(0).cast("long").alias("mark2"), F.lit(0).alias("start"), "len").where("false")
    for g in grams:
        part = table.where(F.col("gram") == g).select("hash", "off", "len")
        at = read.select(*both, "n", F.posexplode(_grams(F.col("w"), F.col("n"), g)).alias("pos", "hash"))
        at = at.join(F.broadcast(bitmap(part, "hash")), in_bitmap(F.col("hash")), "left_semi")
        met = at.join(part, "hash").withColumn("start", F.col("pos") - F.col("off")).where("start >= 0 AND start + len <= n")
        found = found.unionByName(met.select(*both, "start", "len"))
    hits = saved(found.groupBy(*both).agg(F.collect_set(F.struct("start", "len")).alias("found")))
    # the row itself travels as one struct, so that its names meet no other
    rows = docs.select(F.struct("*").alias("doc"), *marks)
    some = F.broadcast(saved(bitmap(hits, "mark")))
    maybe = rows.join(some, in_bitmap(F.col("mark")), "left_semi").join(hits, both, "left")
    words = words_of(F.col("doc.text"))
    cuts = F.transform("found", lambda h: F.struct(h["start"].alias("start"), h["len"].alias("len"), F.array_join(F.slice("w", h["start"] + 1, h["len"]), " ").alias("text")))
    maybe = saved(maybe.withColumn("w", words).withColumn("cuts", cuts).withColumn("n_words", F.size("w").cast("long")).drop("w", "found"))
    each = maybe.select(*both, F.explode("cuts").alias("cut")).distinct().select(*both, "cut.*")
    true = each.join(held.select("text", "item"), "text").groupBy(*both).agg(F.collect_set(F.struct("start", "len")).alias("true"), F.array_sort(F.collect_set("item")).alias("items"))
    places = F.flatten(F.transform("true", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))
    maybe = maybe.join(true, both, "left").select("doc", "n_words", F.coalesce(F.array_sort(F.array_distinct(places)), F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    never = rows.join(some, in_bitmap(F.col("mark")), "left_anti").select("doc", F.size(words).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    new = ("n_words", "hits", "items")
    return maybe.unionByName(never).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in new], *new)
