"""Places over ranges: ranks, medians, metrics of pairs, halves, prompts and draws, with hot groups and ties."""

import math
import random
import statistics

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from assayframe.functions import stats
from assayframe.operators import benchmarks as B
from assayframe.operators import ordered, tables
from assayframe.operators import votes as V
from assayframe.plans import catalogue


@pytest.fixture
def many_ranges(spark):
    """Small adaptive sizes and many partitions, so that groups lie in many ranges."""
    put = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_fresh_rows():
    b = pa.record_batch({"a": pa.array([None, None, 1, 1, 2]), "x": pa.array([float("nan"), float("nan"), None, 2.0, 2.0])})
    assert ordered.fresh_rows(b, ["a", "x"], None).tolist() == [True, False, True, True, True]
    assert ordered.fresh_rows(b, [], None).tolist() == [True, False, False, False, False]
    assert ordered.fresh_rows(b, ["a"], b.slice(0, 1)).tolist() == [False, False, True, False, True]
    assert ordered.fresh_rows(b, ["a"], b.slice(4, 1)).tolist() == [True, False, True, False, True]
    assert ordered.fresh_rows(b, [], b.slice(4, 1)).tolist() == [False] * 5


def test_running_counts_with_a_hot_group(spark, many_ranges):
    """A third of all rows in one group, ties, null groups and values."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", None, *[f"g{i}" for i in range(40)]]), rng.choice([None, *range(25)]), rng.randrange(4)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, v int, w long")
    key = lambda x: (x is not None, x)
    got = {}
    for r in ordered.value_places(df, ["g"], "v", "w").collect():
        got[r.g, r.v] = (r.n, r.before)
    want = {}
    for g in {r[0] for r in rows}:
        before = 0
        for v in sorted({r[1] for r in rows if r[0] == g}, key=key):
            n = sum(r[2] for r in rows if r[0] == g and r[1] == v)
            want[g, v] = (n, before)
            before += n
    assert got == want
    numbered = ordered.running(df, ["g"], ["v"]).groupBy("g").agg(F.sort_array(F.collect_list("before")).alias("b")).collect()
    assert all(r.b == list(range(len(r.b))) for r in numbered) and sum(len(r.b) for r in numbered) == len(rows)
    assert ordered.running(df.where("false"), [], ["v"]).count() == 0


def test_ranks_over_many_ranges(spark, many_ranges):
    """Distinct values and tie runs over 24 ranges: ranks as SQL has them, ranges even."""
    values = [(i, float(i // 7 if i % 3 else i)) for i in range(30_000)]
    df = spark.createDataFrame(values, "id long, v double")
    got = pd.DataFrame([tuple(r) for r in stats.average_ranks(df, "v", "rank").collect()], columns=["v", "id", "rank"]).sort_values("id")
    expect = pd.Series([v for _, v in values]).rank()
    assert (got["rank"].to_numpy() == expect.to_numpy()).all()
    counted = ordered.counted_ranges(df.withColumn("w", F.lit(1)), [], ["v", "id"], "w")
    sizes = [r["count"] for r in counted.groupBy("_p").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 2 * statistics.median(sizes)
    assert stats.average_ranks(df.withColumn("v", F.when(F.col("id") > 4, F.col("v"))), "v", "rank").count() == len(values) - 5


def test_metric_block_weights_and_flat_sides(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([0.0, 1.5, 2.0, 7.0]), rng.choice([0.0, 1.0, 3.5]), rng.randrange(1, 5), rng.choice([0.0, 1.0, None])) for _ in range(300)]
    df = spark.createDataFrame([*rows, ("c", 1.0, 0.1, 3, 1.0), ("c", 2.0, 0.1, 3, None), ("c", None, 0.1, 3, 1.0)], "g string, x double, y double, w long, hit double")
    got = {r.g: r for r in stats.metric_block(df, "x", "y", ["g"], extra={"hits": F.col("hit")}, weight="w").collect()}
    for g in "ab":
        part = pd.DataFrame([(x, y, h) for k, x, y, w, h in rows if k == g for _ in range(w)], columns=["x", "y", "h"])
        r = got[g]
        assert r.n == len(part)
        want = (part.x.corr(part.y), part.x.rank().corr(part.y.rank()), (part.x - part.y).abs().mean(), ((part.x - part.y) ** 2).mean(), part.h.mean())
        assert np.allclose((r.pearson, r.spearman, r.mae, r.mse, r.hits), want) and math.isclose(r.rmse, r.mse**0.5)
    assert got["c"].n == 6 and math.isnan(got["c"].pearson) and math.isnan(got["c"].spearman) and got["c"].hits == 1.0
    none = stats.metric_block(df.where("false"), "x", "y").collect()
    assert len(none) == 1 and none[0].n == 0 and math.isnan(none[0].pearson)


def test_medians_by_brute_force(spark, many_ranges):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, float(rng.randrange(9)), rng.random()]), float(rng.randrange(3))) for _ in range(3000)] + [("one", 2.0, None), ("two", 1.0, 5.0), ("two", 4.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: (r.median_x, r.median_y) for r in ordered.medians(df, ["g"], ["x", "y"]).collect()}
    middle = lambda v: statistics.median(v) if v else None
    assert got == {g: tuple(middle([r[i] for r in rows if r[0] == g and r[i] is not None]) for i in (1, 2)) for g in {r[0] for r in rows}}
    pairs = spark.createDataFrame([("a", 1.0, 2.0, 1.0), ("a", 3.0, 2.0, -1.0), (None, 9.0, None, None)], "split string, source double, synthetic double, delta double")
    found = {r.split: tuple(r)[1:] for r in B.by_split(pairs).collect()}
    assert found == {"a": (2, 2.0, 2.0, 2.0, 2.0, 0.0, 0.0), "all": (3, 13 / 3, 3.0, 2.0, 2.0, 0.0, 0.0), None: (1, 9.0, 9.0, None, None, None, None)}


def test_shared_out_gives_no_task_a_hot_key(spark, many_ranges):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("v"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("of"), F.max("v").alias("top"))
    out = ordered.shared_out(rows, table, ["k"], "of")
    assert out.count() == 6000 and out.columns == ["k", "v", "top"]
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    assert ordered.shared_out(rows, table.where("k > 2"), ["k"], "of").count() == rows.where("k > 2").count()


def test_lattice_draws_whole_halvings(spark):
    """Every iteration by hand; rows of more votes than the lattice lists are split by digests."""
    import hashlib

    rng = random.Random(6)
    data = {i: [(f"a{j}", rng.randrange(3)) for j in range(rng.choice([1, 2, 3, 4, 5, 7]))] for i in range(60)}
    votes = spark.createDataFrame([(i, a, s) for i, v in data.items() for a, s in v], "row_id long, annotator string, score int")
    for most in (10, 4):
        got = {r.iteration: r for r in stats.split_half_lattice(votes, 9, most=most).collect()}
        assert sorted(got) == list(range(9))
        for it in range(9):
            xs, ys = [], []
            for i, v in data.items():
                if len(v) < 2:
                    continue
                if len(v) <= most:
                    masks = [m for m in range(1 << len(v)) if bin(m).count("1") == len(v) // 2]
                    digits = hashlib.md5(f"13:{it // 4}:{i}".encode()).hexdigest()[8 * (it % 4) :][:8]
                    mask = masks[int(digits, 16) % len(masks)]
                    left, right = [s for j, (_, s) in enumerate(v) if mask >> j & 1], [s for j, (_, s) in enumerate(v) if not mask >> j & 1]
                else:
                    order = [s for _, _, s in sorted((hashlib.md5(f"13:{it}:{i}:{a}".encode()).hexdigest(), a, s) for a, s in v)]
                    left, right = order[: len(v) // 2], order[len(v) // 2 :]
                xs.append(sum(left) / len(left))
                ys.append(sum(right) / len(right))
            x, y = pd.Series(xs), pd.Series(ys)
            assert got[it].n == len(xs) and np.allclose((got[it].pearson, got[it].spearman), (x.corr(y), x.rank().corr(y.rank())))


def test_prompts_with_half_of_all_rows_in_one_group(spark, many_ranges):
    rng = random.Random(12)
    data = [(i, "hot" if i % 2 else f"t{i % 40}", "s", float(rng.randrange(300)), float(rng.choice([3, 11, 12, 13, 13]))) for i in range(900)]
    df = spark.createDataFrame(data, "id long, talk string, speaker string, start double, duration double")
    got = {r.id: r.prompt_id for r in B.nearest_prompts(df).collect()}
    groups = {}
    for x in data:
        groups.setdefault(x[1], []).append(x)
    want = {x[0]: min((d < 8, abs(d - 12), abs(b - x[3]), b, j) for j, _, _, b, d in g if j != x[0])[-1] for g in groups.values() for x in g if len(g) > 1}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_picked_places_are_those_of_the_shuffle(n):
    for k in {1, 2, min(7, n), n}:
        for block in (1, 3, 1 << 16):
            for seed in ("13:joy", "x"):
                places = list(range(n))
                random.Random(seed).shuffle(places)
                assert V.picked_places(seed, n, k, block) == places[:k]


def test_exact_draw(spark, many_ranges):
    data = [("hot" if i % 2 else f"l{i % 6}", i) for i in range(2000)]
    df = spark.createDataFrame(data, "label string, row_id long").withColumn("place", F.lit("x"))
    got = {(r.label, r.row_id) for r in V.stratified_exact(df.drop("place"), "label", "row_id", 9).collect()}
    want = set()
    for label in {x for x, _ in data}:
        ids = sorted(i for x, i in data if x == label)
        random.Random(f"13:{label}").shuffle(ids)
        want |= {(label, i) for i in ids[:9]}
    assert got == want
    with pytest.raises(Exception, match="needed"):
        V.stratified_exact(df.drop("place").limit(20), "label", "row_id", 9).collect()


def test_draw_query_by_hand(spark):
    rows = duckdb.sql(f"SELECT lang, doc_id FROM '{DATA}/documents.parquet' WHERE lang IS NOT NULL ORDER BY 2").fetchall()
    want = set()
    for lang in {x for x, _ in rows}:
        ids = [i for x, i in rows if x == lang]
        random.Random(f"13:{lang}").shuffle(ids)
        want |= {(i, lang) for i in ids[:10]}
    assert {(r.doc_id, r.lang) for r in catalogue.QUERIES["stratified_shuffle"](spark, DATA).collect()} == want


def test_scopes_of_threads_are_their_own(spark):
    import threading

    found = {}

    def other():
        with tables.temporary(spark):
            found["inner"] = tables.scratch(spark)
        found["outside"] = tables._scopes.get()

    with tables.temporary(spark) as keep:
        mine = keep(tables.saved(spark.range(3)))
        gone = tables.saved(spark.range(4))
        t = threading.Thread(target=other)
        t.start()
        t.join()
        assert gone.count() == 4 and found["outside"] == ()
    assert mine.count() == 3
    with pytest.raises(Exception, match=r"PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(gone._saved_at).count()


def test_all_rows_median_comes_from_the_splits_counts(spark, many_ranges):
    """Each row is counted once per column; nulls, a split without a name and lone values included."""
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, float(rng.randrange(5)), rng.random()]), rng.random() if i % 3 else 0.5, None) for i in range(800)]
    df = spark.createDataFrame(rows, "split string, source double, synthetic double, delta double")
    counts = ordered.value_counts(df, ["split"], ["source", "synthetic", "delta"])
    assert counts.agg(F.sum("n")).first()[0] == sum(v is not None for r in rows for v in r[1:])
    assert B.by_split(df)._jdf.queryExecution().executedPlan().toString().count("Generate explode") == 0  # values are counted before, once
    got = {r.split: r for r in B.by_split(df).collect()}
    for name in ("hot", "b", None, "all"):
        part = [r for r in rows if name == "all" or r[0] == name]
        source = [r[1] for r in part if r[1] is not None]
        assert got[name].n == len(part) and got[name].median_source == statistics.median(source) and got[name].median_synthetic == statistics.median(r[2] for r in part)
        assert math.isclose(got[name].mean_source, statistics.fmean(source)) and got[name].mean_delta is None and got[name].median_delta is None
