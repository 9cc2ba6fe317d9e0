"""Findings of round 3: plans that must not hold pairs or broadcast what grows, kernels against their plain forms."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from locusframe.functions import scalars as S
from locusframe.operators import aggregates, intervals, kernels, windows
from locusframe.streaming import streams

ON = ("c", "s", "e"), ("c2", "s2", "e2")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tracks(spark, n=300, seed=1):
    rng = random.Random(seed)
    a = [(i, rng.choice([None, "x", "y"]), s := rng.randrange(-40, 40), s + rng.randrange(-2, 30)) for i in range(n)]
    b = [(i, rng.choice([None, "x", "z"]), s := rng.randrange(-40, 40), s + rng.randrange(-2, 30)) for i in range(n)]
    return a, b, spark.createDataFrame(a, "k long, c string, s int, e int"), spark.createDataFrame(b, "k2 long, c2 string, s2 long, e2 long")


def test_overlaps_are_counted_without_pairs(spark):
    """What pairs would tell, but no row is listed by bins."""
    a, b, left, right = tracks(spark)
    want = {x[0]: sum(x[1] is not None and x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3] for y in b) for x in a}
    counted = intervals.overlap_join(left, right, *ON, 7, "count", "k")
    assert {r.k: r.n_overlaps for r in counted.collect()} == want
    assert sorted(r.k for r in intervals.overlap_join(left, right, *ON, 7, "semi", "k").collect()) == sorted(k for k, n in want.items() if n)
    assert sorted(r.k for r in intervals.overlap_join(left, right, *ON, 7, "anti", "k").collect()) == sorted(k for k, n in want.items() if not n)
    assert "r_bin" not in plan(counted)


def test_a_shuffled_join_is_not_broadcast(spark, tmp_path):
    """the planner takes listed rows for one each, so a table of few bytes was broadcast with all its bins."""
    for name, col in (("a", "k"), ("b", "k2")):
        end = "2" if name == "b" else ""
        spark.range(2000).select(F.col("id").alias(col), (F.col("id") % 9).alias(f"c{end}"), F.col("id").alias(f"s{end}"), (F.col("id") + 50).alias(f"e{end}")).write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    assert "Broadcast" not in plan(intervals.overlap_join(left, right, *ON, 4, strategy="shuffle", salt=4))


def test_ranges_are_solved_as_a_whole(spark):
    """one group for each range, not for each contig of it, and no table of contigs is broadcast."""
    a, b, left, right = tracks(spark, seed=2)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    for parts in (1, 5):
        found = intervals.range_overlap_join(left, right, *ON, "k", "k2", parts)
        assert sorted(map(tuple, found.collect())) == want
    assert "FlatMapCoGroupsInPandas [pid#" in plan(found) and "Broadcast" not in plan(found)
    assert plan(found).split("FlatMapCoGroupsInPandas [", 1)[1].split("]", 1)[0].count("#") == 1


def test_bins_are_not_broadcast(spark, tmp_path):
    """F16: few rows that tile into many look small to the planner."""
    spark.range(30).select(F.col("id").alias("c"), F.lit(0).cast("long").alias("s"), F.lit(2699).cast("long").alias("e")).write.parquet(str(tmp_path / "w"))
    spark.range(5000).select((F.col("id") % 30).alias("c"), (F.col("id") % 2700).alias("at")).write.parquet(str(tmp_path / "p"))
    bins = intervals.tile(spark.read.parquet(str(tmp_path / "w")), "s", "e", 30).select("c", "bin_start", "bin_end")
    out = intervals.count_starts(bins, spark.read.parquet(str(tmp_path / "p")), "c", "bin_start", "bin_end", "at", 30)
    assert "Broadcast" not in plan(out)
    assert out.agg(F.count("*"), F.sum("n")).first() == (30 * 90, 5000)


def test_percent_rounds_as_printf(spark):
    """exact ties go to even, other values by their exact binary value."""
    cases = [(13, 32), (15, 32), (1, 32), (3, 32), (29, 20000), (1, 20000), (3, 20000), (2001, 20000), (1, 3), (7, 7), (0, 5), (5, 0), (2999, 4000), (1001, 4000)]
    d = spark.createDataFrame(cases, "a long, n long")
    found = d.select("a", "n", S.percent(F.col("a"), F.col("n")).alias("p")).collect()
    assert [r.p for r in found] == ["%.2f%%" % (100 * a / n) if n else "NA" for a, n in cases]


def test_log_factorials_of_large_counts(spark):
    """as precise as lgamma, and no binomial probability underflows."""
    sizes = [0, 1, 2, 31, 32, 33, 100, 5000, 3_000_000]
    found = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", S.log10_factorial(F.col("n")).alias("x")).collect()
    for r in found:
        assert math.isclose(r.x, math.lgamma(r.n + 1) / math.log(10), rel_tol=1e-14, abs_tol=1e-14)
    one = spark.createDataFrame([(5000, 4000)], "n long, k long").select(S.log10_binomial_pmf(F.col("n"), F.col("k"), 0.3).alias("x")).first()
    want = (math.lgamma(5001) - math.lgamma(4001) - math.lgamma(1001) + 4000 * math.log(0.3) + 1000 * math.log(0.7)) / math.log(10)
    assert want < -400 and math.isclose(one.x, want, rel_tol=1e-12)


def test_pairs_are_aligned_side_by_side():
    """F2: the same scores, offsets and CIGARs as pair by pair, ties too, and not slower for being many."""
    rng = random.Random(8)
    for scores in ((25, -50, -110, -6), (3, -1, -4, -1), (2, 0, -1, -1)):
        a = ["".join(rng.choices("ACG", k=rng.randrange(0, 25))) for _ in range(120)]
        b = ["".join(rng.choices("ACG", k=rng.randrange(0, 12))) if rng.random() < 0.5 else x[3:8] + "GG" * rng.randrange(2) + x[11:] for x in a]
        assert kernels.smith_waterman_pairs(a, b, *scores) == [kernels.smith_waterman(x, y, *scores) for x, y in zip(a, b, strict=True)]


def test_mixtures_are_fitted_to_distinct_rows(spark, monkeypatch):
    """F1: the scores of Spark's own fit of all rows, whether the driver or tasks fit the distinct ones."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(5)
    rows = [(i, float(rng.randrange(1, 9) + 5 * (i % 3 == 0)), rng.randrange(5) / 4, i % 2 == 0) for i in range(3000)]
    d = spark.createDataFrame(rows, "k long, x double, y double, good boolean").coalesce(1)
    found = {r.k: r.lod for r in kernels.mixture_scores(d, ["k"], ["x", "y"], "good").collect()}
    monkeypatch.setattr(kernels, "FITTED_HERE", 3)
    spread = {r.k: r.lod for r in kernels.mixture_scores(d, ["k"], ["x", "y"], "good").collect()}
    assert all(math.isclose(found[k], spread[k], abs_tol=1e-6) for k in found)
    m = d.agg(F.avg("x"), F.stddev("x"), F.avg("y"), F.stddev("y")).first()
    scaled = d.select("k", "good", ((F.col("x") - m[0]) / m[1]).alias("x"), ((F.col("y") - m[2]) / m[3]).alias("y"))
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(scaled)
    points, dense = np.array([r[2:4] for r in scaled.orderBy("k").select("k", "good", "x", "y").collect()]), []
    for side in (True, False):
        model = GaussianMixture(k=2, seed=7).fit(vectors.filter(F.col("good") == side))
        covs = np.array([g.cov.toArray() + 1e-6 * np.eye(2) for g in model.gaussians])
        dense.append(np.log10(kernels._densities(points, np.array(model.weights), np.array([g.mean.toArray() for g in model.gaussians]), covs).sum(1)))
    assert np.allclose([found[k] for k in range(3000)], dense[0] - dense[1], atol=1e-4)


def test_series_are_solved_side_by_side(spark):
    """states and posteriors of each series as alone, and one group of Python for a range, not for each series."""
    rng = np.random.default_rng(4)
    sizes = np.array([1, 7, 3, 20, 7])
    begins = np.cumsum(sizes) - sizes
    emissions, start, after = rng.normal(size=(sizes.sum(), 3)), rng.normal(size=(5, 3)), rng.normal(size=(5, 3))
    transitions, last = np.log(rng.dirichlet(np.ones(3), 3)), np.array([-1, 2, -1, 0, 1])
    states = kernels.viterbi_of_series(emissions, begins, sizes, transitions, start, last)
    posteriors = kernels.posteriors_of_series(emissions, begins, sizes, transitions, start, after)
    for n, (b, size) in enumerate(zip(begins, sizes, strict=True)):
        own = emissions[b : b + size]
        assert states[b : b + size].tolist() == kernels.viterbi(own, transitions, start[n], None if last[n] < 0 else int(last[n])).tolist()
        assert np.allclose(posteriors[b : b + size], kernels.forward_backward(own, transitions, start[n], after[n]))
    d = spark.range(50).select((F.col("id") % 5).alias("g"), F.col("id").alias("t"), F.lit(1.0).alias("v"))
    head = plan(kernels.viterbi_segments(d, "g", "t", "v", [1.0, 2.0], 1.0, 0.9, 2)).split("FlatMapCoGroupsInPandas [", 1)[1]
    assert head.split("]", 1)[0].startswith("pid#") and head.split("]", 1)[0].count("#") == 1


def test_long_runs_are_cut_by_task(spark):
    """runs that cross Arrow batches are whole, and no run is a group of Python of its own."""
    rng = random.Random(3)
    rows = [(g, t, float(rng.choice([2, 3, 4]) if t % 97 else 0)) for g in (None, 1, 2) for t in range(400)]
    d = spark.createDataFrame(rows, "k long, t long, v double")
    tell = lambda: sorted(map(str, windows.active_regions(d, "k", "t", "v", 1.0, 2, 6).collect()))
    want = tell()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert tell() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in plan(windows.active_regions(d, "k", "t", "v", 1.0, 2, 6))


def test_blocks_of_a_lot_of_keys(spark, tmp_path, monkeypatch):
    """keys share a state, and each has its own blocks and versions, null too."""
    monkeypatch.setattr(streams, "LOTS", 2)
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 3, 2**40]), s := rng.randrange(-50, 50), s + rng.randrange(6)) for _ in range(90)]
    for i in range(3):
        spark.createDataFrame(rows[i::3], "c long, s long, e long").coalesce(1).write.parquet(str(tmp_path / "x"), mode="append")
    stream = streams.table_stream(spark, str(tmp_path / "x"), 1)
    blocks = streams.merged_blocks(stream, "c", "s", "e")
    assert ", [lot#" in blocks._jdf.queryExecution().analyzed().toString()
    versions = streams.finished(blocks, "blocks", "update").toPandas()
    found, want = [], []
    for c in {r[0] for r in rows}:
        own = versions[versions["key"].isna()] if c is None else versions[versions["key"] == c]
        found += [(c, *map(int, x)) for x in own[own["version"] == own["version"].max()][["start", "end", "n"]].to_numpy()]
        out: list[list[int]] = []
        for _, s, e in sorted(r for r in rows if r[0] == c):
            if out and s <= out[-1][1] + 1:
                out[-1] = [out[-1][0], max(out[-1][1], e), out[-1][2] + 1]
            else:
                out.append([s, e, 1])
        want += [(c, *x) for x in out]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_allele_counts_of_many_sites(spark):
    """sites side by side give what each gives alone; bad samples don't count."""
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 17 == 0 else [None if (i + j) % 11 == 0 else [0.0, -1.0] if (i + j) % 13 == 0 else np.log10(rng.dirichlet(np.ones(3))).tolist() for j in range(i % 5)]) for i in range(200)]
    found = {r.k: (r.ac, r.qual) for r in kernels.allele_counts(spark.createDataFrame(rows, "k long, gl array<array<double>>"), "k", "gl").collect()}
    assert len(found) == 200
    for i, gl in rows:
        x = np.array([s for s in gl or [] if s is not None and len(s) == 3]).reshape(-1, 3)
        prior = np.array([0.0] + [1e-3 / k for k in range(1, 2 * len(x) + 1)])
        prior[0] = 1 - prior.sum()
        p = kernels.allele_count_posterior(x, np.log10(prior)) if len(x) else np.array([1.0])
        assert found[i][0] == p.argmax() and math.isclose(found[i][1], -10 * math.log10(p[0]), abs_tol=1e-9)
    assert "MapInArrow" in plan(kernels.allele_counts(spark.createDataFrame(rows, "k long, gl array<array<double>>"), "k", "gl"))


def test_dust_of_batches(spark):
    """the scores of S.dust, empty, short and null texts too."""
    rng = random.Random(12)
    rows = [(i, None if i % 19 == 0 else "".join(rng.choices("abz", k=rng.randrange(40) if i % 3 else i % 6))) for i in range(300)]
    d = spark.createDataFrame(rows, "k long, t string")
    want = {r.k: r.x for r in d.select("k", S.dust(F.col("t")).alias("x")).collect()}
    found = {r.k: r.score for r in aggregates.dust_scores(d, "k", F.col("t")).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], abs_tol=1e-12) for k in want)
    assert aggregates.dust_scores(d.limit(0), "k", F.col("t")).count() == 0
