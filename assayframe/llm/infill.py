"""Fill-in-the-middle examples through an index of distinct texts.

Documents are dealt by a 128-bit hash of their text, so identical texts meet in
one sorted run.  A run's texts are compared byte by byte; for each different
one the index holds the byte offsets of its code points once, as an Elias-Fano
list (two to three bits a code point), and every document of the run is joined
to it: its two seeded cuts are two selections in that list, then slices of the
bytes.

A text with many copies is dealt into subgroups of at most a quarter of a
partition's share of rows (``salted``), each with the text in its own index, so
no task gets a whole hot group.

Cuts, with h1 to h4 the first four 8-digit groups of the hex sha256 of
``seed:doc_id`` and n the number of code points: the prefix ends after the
smaller of h1 % (n + 1) and h2 % (n + 1), the middle after the larger.  A text
is left plain if it is empty, holds a marker, or h3 % 100 >= ``rate``; else it
is written suffix first (spm) if h4 % 100 < ``spm``, or prefix first (psm).

Defined cases: a null text is empty; a null key is hashed as the empty string;
rows that repeat give a row each, alike; an empty table gives no row; other
columns are ignored, whatever their names.  A text is a unit that one row holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm._spark import salted, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM, SEED = 90, 20, 1
BLOCK, SLICE = 64, 1 << 20  # bytes of a select block; of a text looked at together while its list is made


class Boundaries:
    """The byte offsets 0 = b[0] < b[1] < ... < b[n] = size of a text's code points, as an Elias-Fano list.

    The lowest ``low_bits`` bits of the offsets stand packed in ``low``; bit
    (b[i] >> low_bits) + i is set in ``high``.  ``ones`` counts the bits set
    before each block of ``high``, so a selection looks into one block only.
    """

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        self.size = len(data)
        heads = lambda a: np.flatnonzero((data[a : a + SLICE] & 0xC0) != 0x80) + a
        self.n = sum(len(heads(a)) for a in range(0, self.size, SLICE))
        self.low_bits = max(0, (self.size // (self.n + 1)).bit_length() - 1)
        high = np.zeros((self.size >> self.low_bits) + self.n + 1, bool)
        low = np.zeros((self.n + 1, self.low_bits), bool)
        done = 0
        for a in [*range(0, self.size, SLICE), None]:
            at = np.array([self.size]) if a is None else heads(a)  # last, the end of the last code point
            high[(at >> self.low_bits) + np.arange(done, done + len(at))] = True
            for bit in range(self.low_bits):
                low[done : done + len(at), bit] = (at >> bit) & 1
            done += len(at)
        self.high = np.packbits(high)
        self.low = np.packbits(low)
        counts = np.bitwise_count(self.high).astype(np.int64)
        starts = np.arange(0, max(1, len(counts)), BLOCK)
        per = np.add.reduceat(counts, starts)
        self.ones = np.cumsum(per) - per

    def select(self, i: int) -> int:
        """b[i]."""
        block = int(np.searchsorted(self.ones, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * BLOCK : (block + 1) * BLOCK])
        at = block * BLOCK * 8 + int(np.flatnonzero(bits)[i - int(self.ones[block])])
        out = at - i
        for bit in range(self.low_bits - 1, -1, -1):
            place = i * self.low_bits + bit
            out = out * 2 + ((int(self.low[place >> 3]) >> (7 - (place & 7))) & 1)
        return out


def seeds(key: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4 of a key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infilled(docs: DataFrame, key: str = "doc_id", rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """``docs(key, text)`` as key, n, form, prefix_chars, middle_chars (null if plain) and output."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("key", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    n = F.char_length("text").cast("long")
    h1, h2, h3, h4 = seeds(F.col("key"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    cuts = salted(rows, ["k1", "k2"]).withColumn("n", n).withColumns({"c1": h1 % (F.col("n") + 1), "c2": h2 % (F.col("n") + 1), "form": form})
    cuts = cuts.select("key", "k1", "k2", "salt", "n", "form", F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"), "text")
    runs = cuts.repartition("k1", "k2", "salt").sortWithinPartitions("k1", "k2").drop("salt")
    kind = docs.schema[key].dataType.simpleString()
    return runs.mapInArrow(_joined, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", key)


def _joined(batches):
    """Documents in runs of equal hashes, each joined to the index entry of its text."""
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    run, entries = None, {}  # of the present run: text -> its boundaries
    for b in batches:
        keys = zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), strict=True)
        texts = b.column("text").cast(pa.binary())
        out, ends, mids = [], [], []
        rows = zip(keys, b.column("form").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist(), texts, strict=True)
        for at, form, x, y, text in rows:
            text = text.as_py()
            if form == "plain":
                out.append(text)
                ends.append(None)
                mids.append(None)
                continue
            if at != run:
                run, entries = at, {}
            held = entries.get(text)  # a dictionary of bytes compares them whole
            if held is None:
                held = entries[text] = Boundaries(text)
            x1, y1 = held.select(x), held.select(y)
            head, mid, tail = text[:x1], text[x1:y1], text[y1:]
            out.append(b"".join((p, head, s, tail, m, mid) if form == "psm" else (s, tail, p, head, m, mid)))
            ends.append(x)
            mids.append(y - x)
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("n"), b.column("form"), pa.array(ends, pa.int64()), pa.array(mids, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
            ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
