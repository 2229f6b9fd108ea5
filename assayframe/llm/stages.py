"""What the stages of the corpus pipeline decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm import decontaminate, jaccard, langid, mixing, sharding

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = [f"shard-{i:03d}" for i in range(64)]
SURE = 0.3


def identified(docs: DataFrame) -> DataFrame:
    """Documents in a learned language, ``lang`` being the predicted one.

    Rejected are texts that are null or hold no letter, texts stranger than all
    labelled ones (see ``langid``), and texts of which no language has a
    calibrated probability of SURE.  Rows that repeat are judged alike; without
    any labelled text nothing stays.
    """
    docs = docs.select(*COLUMNS)
    taught = docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang")
    found = langid.predict(docs, langid.fit(taught))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE) & ~F.col("strange"))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8); see ``jaccard.first_of_each``."""
    return jaccard.first_of_each(docs.select(*COLUMNS), size=5, num=80, den=100)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents in which no window of the benchmark occurs; null and empty texts stay, rows that repeat are judged alike."""
    found = decontaminate.decontaminate(docs.select(*COLUMNS), items.select("item_id", "text"))
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: a row per document and pass.

    A document that a pass takes whole keeps its text; of one taken in part the
    words taken stay, joined by single spaces.  Rows that repeat are documents
    of their own; null and empty texts are never taken.
    """
    docs = docs.select(*COLUMNS).withColumn("mark", F.xxhash64(*COLUMNS)).withColumn("mark2", F.xxhash64(F.lit(1), *COLUMNS))
    key = ["mark", "mark2"]
    pieces, _, _ = mixing.mix(docs.select(*key, "text", "source"), key=key)
    per = pieces.groupBy(*key, "copy", "pass", "size").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("start", F.col("words").alias("n")))).alias("cuts"))
    both = docs.dropDuplicates(key).join(per, key)
    words = F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), F.lit(1))
    some = F.flatten(F.transform("cuts", lambda c: F.slice(F.col("w"), (c["start"] + 1).cast("int"), c["n"].cast("int"))))
    whole = F.col("words") == F.col("size")
    both = both.withColumn("w", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(some, " ")))
    return both.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def sharded(docs: DataFrame) -> DataFrame:
    """The documents with their shard; rows without doc_id go to one shard, by the hash of null."""
    return sharding.place(docs.select(*COLUMNS), SHARDS).drop("slot")
