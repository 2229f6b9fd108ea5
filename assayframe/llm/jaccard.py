"""N-gram Jaccard join by a token-group matrix.

Similar documents are put into groups; a group's column of the matrix is the
union of its sets.  A query set can only be similar to a member if enough of
its shingles are in the union; only then is the group opened and the exact
overlap with its members counted.

Which columns a query has to look at is read off an index of rare shingles.
All shingles have one order: by how frequent their bucket of a fixed-size
sketch is, then by hash.  A set lists its first ``n - needed + 1`` shingles; two
similar sets share one of them, at places that leave room for the overlap they
need.  Any order finds every link; the sketch only puts what many texts share
last, so that common passages are hardly ever listed.  It holds the buckets that
stand out in a task, and all shingles that the lists by hash alone, a quarter
longer than needed, would name ``OFTEN`` times or more.

The join has two rounds.  First every list names a leader, the set with the
fewest rare shingles, which is a group of its own, and the list's other sets
query it: a family of n near copies makes n pairs, not n * n.  Sets
with one leader are one cluster, cut into groups of at most ``GROUP`` sets.  In
the second round only lists that hold several clusters are looked at: the sets
outside the cluster of a list's leader query the groups of the others.  Nothing
is estimated and no list is cut: every link between clusters is found.
Lists of hot shingles are split by salt in the first round.

Defined cases: a null or empty text has the empty set and is linked with
nothing; a text of fewer words than a shingle has its whole sequence as one;
equal sets are linked; rows of one doc_id count as one document; a row without
doc_id is linked like any other, but its component has a number only where a
document with one is in it; an empty table gives no row; other columns are
ignored.  doc_id must lie
between -2**62 and 2**62.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm._spark import discard, fetched_bitmap, in_bitmap, saved, shuffle_partitions, small_batches, temporary
from assayframe.llm._text import mix64, sets_of
from assayframe.llm.components import components

GROUP, GROUP_SHINGLES = 256, 400_000
SKETCH = 1 << 22  # buckets; one byte of each is broadcast
UNIT = 64  # queries that travel to a column together
SALTED = 8  # lists of shingles at this level (2**8 sets in hot tasks) or above are split
OFTEN = 16
NAMELESS = 1 << 62
_KEY1, _KEY2 = (np.uint64(x) for x in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
FEATURES = "doc_id long, n long, k1 long, k2 long, z binary, low array<long>"
POSTINGS = "token long, salt int, rare int, id long, n int, pos int"


class Threshold:
    """Jaccard similarity of at least ``num / den``, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def similar(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)

    def needed(self, n):
        """Shingles of a set of n that any partner must share; also the least size of a partner."""
        return -(-self.num * n // self.den)

    def overlap(self, a, b):
        """Shingles that similar sets of these sizes share at least."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def listed(self, n: int) -> int:
        return n - self.needed(n) + 1

    def room(self, n: Column, pos: Column, least: Column, most: Column, first: Column) -> Column:
        """Whether a set of n with a shingle at ``pos`` may be similar to one of least .. most shingles that has it at ``first`` or later."""
        small = F.greatest(least, F.ceil(F.lit(self.num) * n / self.den))
        need = F.ceil(F.lit(self.num) * (n + small) / (self.num + self.den))
        return (F.lit(self.num) * least <= F.lit(self.den) * n) & (F.lit(self.num) * n <= F.lit(self.den) * most) & (F.least(n - pos, most - first) >= need)


def nameless(k1: str) -> Column:
    """The number of a set that no row with a doc_id has."""
    return F.lit(NAMELESS) + F.col(k1).bitwiseAND(F.lit(NAMELESS - 1))


def bucket_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(20)).astype(np.int64) & (SKETCH - 1)


def signed(x) -> int:
    x = int(x)
    return x - 2**64 if x >= 2**63 else x


def features(docs: DataFrame, size: int, t: Threshold) -> DataFrame:
    """doc_id, n, the set's 128-bit key, packed text and first shingles by hash of each row.

    Every task ends with a row of n = -1 that holds its hot buckets and their counts.
    """

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        counts, waiting, held, total = np.zeros(SKETCH, np.uint32), [], 0, 0

        def count():
            nonlocal held, total
            if waiting:
                counts.__iadd__(np.bincount(bucket_of(np.concatenate(waiting)), minlength=SKETCH).astype(np.uint32))
            total, held = total + held, 0
            waiting.clear()

        def batch(ids, rows):
            n, k1, k2, z, low = (list(c) for c in zip(*rows, strict=True))
            first = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in low])]), pa.int32()), pa.array(np.concatenate(low).view(np.int64)))
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(z, pa.binary()), first], ["doc_id", "n", "k1", "k2", "z", "low"])

        for b in batches:
            rows, texts = [], b.column(1)
            for i, s in sets_of(texts, size):
                if len(s) == 0:
                    rows.append((0, 0, 0, b"", s))
                    continue
                rows.append((len(s), signed(mix64(s ^ _KEY1).sum(dtype=np.uint64)), signed(mix64(s ^ _KEY2).sum(dtype=np.uint64)), pack.compress(texts[i].as_buffer()), s[: t.listed(len(s)) * 5 // 4]))
                waiting.append(s)
                held += len(s)
                if held > 1 << 20:
                    count()
            if rows:
                yield batch(b.column(0), rows)
        count()
        noise = total / SKETCH
        hot = np.flatnonzero(counts >= max(4, noise + 6 * noise**0.5))
        if len(hot):
            packed = hot.astype(np.uint32).tobytes() + counts[hot].tobytes()
            yield batch(pa.array([None], pa.int64()), [(-1, 0, 0, packed, np.zeros(0, np.uint64))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def sketch(rows: DataFrame) -> np.ndarray:
    """The level of every bucket: the logarithm of its count, 0 where it is neither hot in a task nor often listed."""

    def run(batches):
        for b in batches:
            for z in b.column(0).to_pylist():
                both = np.frombuffer(z, np.uint32).astype(np.int64)
                at, n = both[: len(both) // 2], both[len(both) // 2 :]
                for lo in range(0, len(at), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], ["bucket", "n"])

    hot = rows.where("n = -1").select("z").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    often = rows.select(F.explode("low").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    often = often.select(F.shiftrightunsigned("token", 20).bitwiseAND(F.lit(SKETCH - 1)).alias("bucket"), "n")
    level = F.floor(F.log2(F.max("n"))).cast("int").alias("level")
    out = hot.unionByName(often).groupBy("bucket").agg(level).toArrow()  # SKETCH rows at most
    levels = np.zeros(SKETCH, np.uint8)
    levels[out.column("bucket").to_numpy()] = out.column("level").to_numpy()
    return levels


def unpacked(zs: list[bytes], size: int) -> list[np.ndarray]:
    """Shingle sets of packed texts."""
    tool = zstandard.ZstdDecompressor()
    texts = pa.array([tool.decompress(z) for z in zs], pa.binary())
    return [s for _, s in sets_of(texts, size)]


def listed(s: np.ndarray, levels: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles that a set lists, in order, their levels, and how many of all are rare."""
    level = levels[bucket_of(s)]
    at = np.argsort(level, kind="stable")[: t.listed(len(s))]  # sets are sorted by hash
    return s[at], level[at], int(np.count_nonzero(level == 0))


def postings(sets: DataFrame, levels: np.ndarray, size: int, t: Threshold) -> DataFrame:
    """A row for each shingle that a set of ``sets(id, z)`` lists; salt is -1 where its list is whole."""
    held = sets.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        out, n = [], 0

        def batch():
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "salt", "rare", "id", "n", "pos"])

        for b in batches:
            zs = b.column(1).to_pylist()
            at = 0
            while at < len(zs):
                stop = min(len(zs), at + 200)
                for id_, s in zip(b.column(0).slice(at, stop - at).to_pylist(), unpacked(zs[at:stop], size), strict=True):
                    tokens, level, rare = listed(s, held.value, t)
                    k = len(tokens)
                    own = int(mix64(np.array([id_], np.int64).view(np.uint64))[0] >> np.uint64(33))
                    salt = np.where(level >= SALTED, own & ((1 << np.maximum(level.astype(np.int64) - SALTED + 1, 0)) - 1), -1)
                    full = lambda x, kind: np.full(k, x, kind)
                    out.append((tokens.view(np.int64), salt.astype(np.int32), full(rare * 1_000_000 // len(s), np.int32), full(id_, np.int64), full(len(s), np.int32), np.arange(k, dtype=np.int32)))
                    n += k
                    if n > 50_000:
                        yield batch()
                        n = 0
                at = stop
        if out:
            yield batch()

    return sets.select("id", "z").mapInArrow(run, POSTINGS)


class Group:
    """Sets as one column of the matrix: their union, and who holds what."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        fresh = np.ones(len(tokens), bool)
        np.not_equal(tokens[1:], tokens[:-1], out=fresh[1:])
        self.first = np.append(np.flatnonzero(fresh), len(tokens))
        self.union = tokens[fresh]

    def partners(self, q: np.ndarray, t: Threshold) -> np.ndarray:
        """Members similar to ``q``."""
        at = np.searchsorted(self.union, q)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == q]
        lo, hi = self.first[at], self.first[at + 1]
        size = hi - lo
        where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        overlap = np.bincount(self.owner[where], minlength=len(self.sizes))
        return np.flatnonzero(t.similar(overlap, len(q), self.sizes))


def short(s: np.ndarray) -> np.ndarray:
    """Shingles as a column stores them: 32 bits, which can only raise an overlap."""
    return np.unique((s >> np.uint64(32)).astype(np.uint32))


def matrix(members: DataFrame, size: int) -> DataFrame:
    """``members(g, ids, zs)`` with the column of each group: the union of its sets, least and largest size."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                sets = unpacked(one.column(2)[0].as_py(), size)
                n = [len(s) for s in sets]
                union = short(np.concatenate(sets)).tobytes()
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([min(n)], pa.int64()), pa.array([max(n)], pa.int64()), pa.array([union], pa.binary())], ["g", "ids", "zs", "low", "high", "column"])

    return members.mapInArrow(run, "g long, ids array<long>, zs array<binary>, low long, high long, column binary")


def may_hold(column: np.ndarray, low: int, high: int, q: np.ndarray, t: Threshold) -> bool:
    """The bound: whether a group of such a column can have a member similar to ``q``."""
    n = len(q)
    least = max(low, t.needed(n))
    if least > min(high, t.den * n // t.num):
        return False
    at = np.searchsorted(column, own := short(q))
    at[at == len(column)] = 0
    # shingles of q that fold into one count as many as they may be
    return int(np.count_nonzero(column[at] == own)) + n - len(own) >= t.overlap(n, least)


def only_named(rows: DataFrame, column: str, named: DataFrame) -> DataFrame:
    """The rows whose number is in ``named(id)``, and few others."""
    table = fetched_bitmap(named.select(F.xxhash64("id").alias("hash")), "hash")
    return rows.join(F.broadcast(table), in_bitmap(F.xxhash64(column)), "left_semi")


LINKS = "a long, na long, b long, nb long"


def links(pairs: DataFrame, sets: DataFrame, columns: DataFrame, size: int, t: Threshold) -> DataFrame:
    """A link of each of ``pairs(q, g)`` whose group g has members similar to the set q, to the first of them: ids and sizes of both."""
    often = saved(pairs.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / UNIT).alias("units")))
    dealt = pairs.join(often.hint("merge"), "g").select("g", "q", F.pmod(F.xxhash64("q"), F.col("units")).alias("unit"))
    own = only_named(sets, "id", pairs.select(F.col("q").alias("id"))).select(F.col("id").alias("q"), "z")
    units = dealt.join(own, "q").groupBy("g", "unit").agg(F.collect_list(F.struct("q", "z")).alias("queries"))
    both = units.join(columns.hint("merge"), "g").select("g", "queries", "ids", "zs", "low", "high", "column")
    return both.mapInArrow(lambda batches: queried(batches, size, t), LINKS).where("a <> b")


def led_links(pairs: DataFrame, sets: DataFrame, columns: DataFrame, size: int, t: Threshold) -> DataFrame:
    """The same where most groups are leaders with few queries: each pair travels to its column on its own."""
    own = only_named(sets, "id", pairs.select(F.col("q").alias("id"))).select(F.col("id").alias("q"), "z")
    each = pairs.join(own.hint("merge"), "q").select("g", F.array(F.struct("q", "z")).alias("queries"))
    both = each.join(columns.hint("merge"), "g").select("g", "queries", "ids", "zs", "low", "high", "column")
    return both.mapInArrow(lambda batches: queried(batches, size, t), LINKS).where("a <> b")


def queried(batches, size: int, t: Threshold):
    """Links of groups (g, queries, ids, zs, low, high, column): a group's texts are unpacked for the first query that passes its bound."""
    now = column = opened = None
    for b in batches:
        found = []
        for i in range(b.num_rows):
            g, queries, ids, low, high = (b.column(c)[i].as_py() for c in (0, 1, 2, 4, 5))
            if g != now:
                now, column, opened = g, np.frombuffer(b.column(6)[i].as_py(), np.uint32), None
            for q, s in zip((x["q"] for x in queries), unpacked([x["z"] for x in queries], size), strict=True):
                if may_hold(column, low, high, s, t):
                    opened = opened or Group(unpacked(b.column(3)[i].as_py(), size))
                    p = opened.partners(s, t)
                    if len(p):
                        found.append((q, len(s), ids[p[0]], int(opened.sizes[p[0]])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "na", "b", "nb"])


def led(lists: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (q, g): the sets of each list and its leader, where they may be similar."""
    fits = t.room(F.col("n"), F.col("pos"), F.col("leader.n"), F.col("leader.n"), F.col("leader.pos"))
    return lists.where((F.col("id") != F.col("leader.id")) & fits).select(F.col("id").alias("q"), F.col("leader.id").alias("g")).distinct()


def clusters(near: DataFrame) -> DataFrame:
    """id, n, root of the sets in ``near(a, na, b, nb)``: a set follows its least leader, and that one's."""
    to = near.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("lead"), F.first("na").alias("n"))
    lone = near.select(F.col("b").alias("id"), F.col("b").alias("lead"), F.col("nb").alias("n"))
    first = saved(to.withColumn("own", F.lit(0)).unionByName(lone.withColumn("own", F.lit(1))).groupBy("id").agg(F.min_by("lead", "own").alias("lead"), F.first("n").alias("n")))
    over = first.select(F.col("id").alias("lead"), F.col("lead").alias("root"))
    return first.join(over, "lead").select("id", "n", "root")


def grouped(rows: DataFrame) -> DataFrame:
    """``rows(id, n, root)`` with the group g, a number below all ids: at most GROUP sets of one cluster."""

    def run(batches):
        gid = (TaskContext.get().partitionId() << 34) - 2**63
        last, held, weight = None, 0, 0
        for b in batches:
            out = []
            for n, root in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if root != last or held >= GROUP or weight + n > GROUP_SHINGLES:
                    gid, last, held, weight = gid + 1, root, 0, 0
                held, weight = held + 1, weight + n
                out.append(gid)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], ["id", "n", "root", "g"])

    rows = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "root", "id").sortWithinPartitions("root", "id")
    return rows.mapInArrow(run, "id long, n long, root long, g long")


def unsettled(lists: DataFrame, groups: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (q, g) of sets and groups of other clusters that a list leaves open.

    The sets outside the cluster of a list's first set meet its groups; two
    groups outside it meet once.  A set in no cluster is a group of its own.
    """
    rows = lists.select("token", "id", "n", "pos", "rare").join(groups.select("id", "root", "g"), "id", "left")
    rows = saved(rows.withColumn("root", F.coalesce("root", "id")).withColumn("g", F.coalesce("g", "id")))
    per = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct("rare", "id", "root")).alias("first")).where("lo < hi")
    rows = saved(rows.join(per.select("token", F.col("first.root").alias("main")), "token").drop("rare"))
    held = rows.groupBy("token", "g", "root", "main").agg(F.min("pos").alias("first"), F.min("n").alias("least"), F.max("n").alias("most"))
    held = held.select("token", F.col("g").alias("h"), F.col("root").alias("of"), "first", "least", "most")
    fits = t.room(F.col("n"), F.col("pos"), F.col("least"), F.col("most"), F.col("first"))
    met = rows.where("root <> main").join(held.hint("merge"), "token").where((F.col("root") != F.col("of")) & ((F.col("of") == F.col("main")) | (F.col("g") > F.col("h"))) & fits)
    return met.select(F.col("id").alias("q"), F.col("h").alias("g")).distinct()


def similar_sets(sets: DataFrame, levels: np.ndarray, size: int, t: Threshold, given: DataFrame | None = None) -> DataFrame:
    """node, root: the components of ``sets(id, n, z)`` and the links ``given(a, b)`` that hold several."""
    alike = Window.partitionBy("token", "salt").orderBy("rare", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lists = postings(sets, levels, size, t).withColumn("held", F.count(F.lit(1)).over(alike)).withColumn("leader", F.first(F.struct("id", "n", "pos")).over(alike))
    # of a list that is split, the other sets may be elsewhere
    lists = saved(lists.where("held > 1 OR salt >= 0").select("token", "id", "n", "pos", "leader", "salt", "rare"))
    pairs = led(lists, t)
    if (levels >= SALTED).any():  # the leaders of a split list follow the first of them
        heads = lists.where("salt >= 0 AND id = leader.id").drop("leader")
        top = heads.groupBy("token").agg(F.min(F.struct("rare", "id", "n", "pos")).alias("leader"))
        pairs = pairs.unionByName(led(heads.join(top, "token"), t)).distinct()
    pairs = saved(pairs)
    heads = only_named(sets, "id", pairs.select(F.col("g").alias("id"))).select(F.col("id").alias("g"), F.array("id").alias("ids"), F.array("z").alias("zs"))
    near = saved(led_links(pairs, sets, matrix(heads, size), size, t))
    groups = saved(grouped(clusters(near)))
    pairs = saved(unsettled(lists, groups, t))
    wanted = pairs.select("g").distinct()
    single = wanted.select(F.col("g").alias("id"), "g").where("g > -4611686018427387904")
    several = groups.select("id", "g").join(wanted, "g", "left_semi")
    wanted = single.unionByName(several.select("id", "g"))
    members = only_named(sets, "id", wanted).join(wanted, "id").groupBy("g").agg(F.collect_list(F.struct("id", "z")).alias("m"))
    members = members.select("g", F.col("m.id").alias("ids"), F.col("m.z").alias("zs"))
    more = links(pairs, sets, matrix(members, size), size, t).select("a", "b")
    edges = near.select("a", "b").unionByName(more)
    return components(edges if given is None else edges.unionByName(given))


def labelled(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, n, k1, k2 (the set's key) and root of every row of ``docs(doc_id, text)``.

    The root is the least doc_id that links reach, a number of NAMELESS or
    above where none of them has one, and null for the empty set.
    """
    spark = docs.sparkSession
    small_batches(spark)
    t = Threshold(num, den)
    with temporary(spark) as keep:
        rows = saved(features(docs, size, t))
        levels = sketch(rows)
        # equal sets are one; the aggregate meets before the shuffle, so many copies of a text are one row a task
        sets = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("z").alias("z"))
        sets = saved(sets.withColumn("id", F.coalesce("id", nameless("k1"))))
        small = keep(saved(rows.where("n >= 0").select("doc_id", "n", "k1", "k2")))
        discard(rows)
        keys = sets.select("k1", "k2", "id")
        given = None
        again = small.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        if not again.isEmpty():  # a document in several rows is linked with itself
            twice = saved(small.join(again, "doc_id").join(keys.hint("merge"), ["k1", "k2"]).select("doc_id", "id").distinct())
            given = twice.join(twice.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b")
        roots = similar_sets(sets, levels, size, t, given)
        keys = keep(saved(keys.join(roots.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("root"))))
    return small.join(keys.hint("merge"), ["k1", "k2"], "left").select("doc_id", "n", "k1", "k2", "root")


def keyed(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` with k1 and k2, the key of the set of ``text``; zeros for the empty set."""

    def run(batches):
        for b in batches:
            keys = [(signed(mix64(s ^ _KEY1).sum(dtype=np.uint64)), signed(mix64(s ^ _KEY2).sum(dtype=np.uint64))) if len(s) else (0, 0) for _, s in sets_of(b.column(b.schema.get_field_index("text")), size)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], [*b.schema.names, "k1", "k2"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "k1 long", "k2 long"])
    return docs.mapInArrow(run, schema)


def first_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that stay when one document of each component does.

    It is the one of least doc_id; of rows of one doc_id the one of least text
    (a row with words first).  Of a component without doc_ids one row stays.
    Rows without words stay, but for further ones of a doc_id.
    """
    found = saved(labelled(docs.select("doc_id", "text"), size, num, den))
    keep = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("root").alias("root")).where("root IS NULL OR root = doc_id").select("doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.trim(F.coalesce("text", F.lit(""))) == "", "text")
    named = docs.join(keep, "doc_id", "left_semi").withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_row").select(*docs.columns)
    lone = found.where(F.col("doc_id").isNull() & (F.col("root") == nameless("k1"))).select("k1", "k2").distinct()
    rest = saved(keyed(docs.where("doc_id IS NULL"), size))
    some = rest.join(lone, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return named.unionByName(some.unionByName(rest.where("k1 = 0 AND k2 = 0")).select(*docs.columns))


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text)``."""
    found = labelled(docs, size, num, den)
    root = F.when(F.col("root") < NAMELESS, F.col("root"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(root).alias("component_id"))
