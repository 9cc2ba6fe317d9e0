"""Kernels against brute force: plain loops over states, cells or genotypes."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe import extensions
from locusframe.operators import copynumber, kernels


def series(spark, n=90):
    rng = random.Random(2)
    rows = [(g, t, rng.choice([1.0, 1.0, 2.0, 4.0]) + rng.random()) for g in (1, 2, 3) for t in range(n if g < 3 else 1)]
    return rows, spark.createDataFrame(rows, "g long, t long, v double")


@pytest.mark.parametrize("parts", [1, 7])
def test_hidden_states_over_ranges(spark, parts):
    """Solved by ranges, a series has the states and posteriors that it has as a whole."""
    rows, d = series(spark)
    means, sd, stay = [1.0, 2.0, 4.0], 1.0, 0.9
    transitions = np.log(np.full((3, 3), 0.05) + np.eye(3) * 0.85)
    states = {(r.g, r.t): r.state for r in kernels.viterbi_segments(d, "g", "t", "v", means, sd, stay, parts).collect()}
    posteriors = {(r.g, r.t): r.posterior for r in kernels.state_posteriors(d, "g", "t", "v", means, sd, stay, parts).collect()}
    for g in (1, 2, 3):
        x = np.array([v for k, _, v in rows if k == g])
        emissions = -((x[:, None] - np.array(means)) ** 2) / (2 * sd * sd)
        start = np.full(3, -math.log(3))
        score = lambda path: start[path[0]] + emissions[0, path[0]] + sum(transitions[a, b] + emissions[i + 1, b] for i, (a, b) in enumerate(itertools.pairwise(path)))  # noqa: B023, E731
        own = [states[g, i] for i in range(len(x))]
        assert math.isclose(score(own), score(kernels.viterbi(emissions, transitions, start).tolist()))
        assert np.allclose([posteriors[g, i] for i in range(len(x))], kernels.forward_backward(emissions, transitions, start))


def test_states_against_all_paths():
    rng = np.random.default_rng(1)
    emissions, start = rng.normal(size=(5, 3)), np.log([0.2, 0.3, 0.5])
    transitions = np.log(rng.dirichlet(np.ones(3), 3))
    paths = {p: start[p[0]] + emissions[0, p[0]] + sum(transitions[a, b] + emissions[i + 1, b] for i, (a, b) in enumerate(itertools.pairwise(p))) for p in itertools.product(range(3), repeat=5)}
    assert tuple(kernels.viterbi(emissions, transitions, start).tolist()) == max(paths, key=paths.get)
    total = sum(map(math.exp, paths.values()))
    want = [[sum(math.exp(x) for p, x in paths.items() if p[t] == s) / total for s in range(3)] for t in range(5)]
    assert np.allclose(kernels.forward_backward(emissions, transitions, start), want)


def plain_hmm(read, q, gap, cont, hap):
    n, h = len(read), len(hap)
    m, i, d = (np.zeros((n + 1, h + 1)) for _ in range(3))
    d[0, :] = 1 / h
    e, o, c = 10 ** (-np.array(q) / 10), 10 ** (-gap / 10), 10 ** (-cont / 10)
    for r in range(1, n + 1):
        for j in range(1, h + 1):
            emit = 1 - e[r - 1] if read[r - 1] == hap[j - 1] or "N" in (read[r - 1], hap[j - 1]) else e[r - 1] / 3
            m[r, j] = emit * ((1 - 2 * o) * m[r - 1, j - 1] + (1 - c) * (i[r - 1, j - 1] + d[r - 1, j - 1]))
            i[r, j] = o * m[r - 1, j] + c * i[r - 1, j]
            d[r, j] = o * m[r, j - 1] + c * d[r, j - 1]
    return math.log10((m[n, 1:] + i[n, 1:]).sum())


def test_pair_hmm(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("ACGTN", [9, 9, 9, 9, 1], k=n))
    rows = [(k, text(rng.randrange(1, 14)), [rng.randrange(2, 40) for _ in range(14)], text(rng.randrange(1, 18))) for k in range(40)]
    d = spark.createDataFrame([*rows, (99, "", [], "ACG")], "k long, r string, q array<int>, h string")
    found = {r.k: r.log10 for r in kernels.likelihoods(d, ["k"], "r", "q", "h", 30, 12, pairs=7).collect()}
    assert set(found) == set(range(40))
    for k, r, q, h in rows:
        assert math.isclose(found[k], plain_hmm(r, q[: len(r)], 30, 12, h), rel_tol=1e-9)
    long = text(400)
    assert math.isfinite(kernels.pair_hmm([long], [[30] * 400], [[45] * 400], [[45] * 400], [[10] * 400], ["T" * 50 + long + "G" * 9])[0])


def cost(cigar_ops, reference, other, offset, s):
    i, j, total = offset, 0, 0
    for size, op in cigar_ops:
        if op == "S":
            j += size
        elif op == "M":
            total += sum(s[0] if reference[i + k] == other[j + k] else s[1] for k in range(size))
            i, j = i + size, j + size
        else:
            total += s[2] + (size - 1) * s[3]
            i, j = (i + size, j) if op == "D" else (i, j + size)
    return total, i, j


def test_smith_waterman():
    """The score is the best of all alignments (by a plain recursion), and the CIGAR has that score."""
    import re
    from functools import lru_cache

    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choices("ACG", k=rng.randrange(1, 9))) for _ in range(2))
        s = (rng.randrange(1, 6), -rng.randrange(0, 5), -rng.randrange(1, 7), -rng.randrange(1, 3))

        @lru_cache(None)
        def best(i, j, state):
            if i == 0 or j == 0:
                return 0 if state == "M" else -math.inf
            if state == "D":
                return max(best(i - 1, j, "M") + s[2], best(i - 1, j, "D") + s[3])  # noqa: B023
            if state == "I":
                return max(best(i, j - 1, "M") + s[2], best(i, j - 1, "I") + s[3])  # noqa: B023
            return max(best(i - 1, j - 1, "M") + (s[0] if a[i - 1] == b[j - 1] else s[1]), best(i, j, "D"), best(i, j, "I"))  # noqa: B023

        want = max([best(i, len(b), "M") for i in range(1, len(a) + 1)] + [best(len(a), j, "M") for j in range(1, len(b) + 1)])
        score, offset, cigar = kernels.smith_waterman(a, b, *s)
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDS])", cigar)]
        total, _, used = cost(ops, a, b, offset, s)
        assert (score, total, used) == (want, want, len(b)), (a, b, s, cigar)
    assert kernels.smith_waterman("ACGTACGT", "GTAC")[1:] == (2, "4M") and kernels.smith_waterman("", "AC") == (0, 0, "2S")


def test_allele_counts(spark):
    rng = np.random.default_rng(3)
    for n in (1, 3):
        x, prior = np.log10(rng.dirichlet(np.ones(3), n)), np.log10(rng.dirichlet(np.ones(2 * n + 1)))
        weights = np.zeros(2 * n + 1)
        for g in itertools.product(range(3), repeat=n):
            ways = math.prod((1, 2, 1)[k] for k in g) / math.comb(2 * n, sum(g))
            weights[sum(g)] += ways * 10 ** sum(x[i, k] for i, k in enumerate(g))
        want = weights * 10**prior
        assert np.allclose(kernels.allele_count_posterior(x, prior), want / want.sum())
    d = spark.createDataFrame([(1, [[0.0, -5.0, -9.0], None]), (2, [[-9.0, -4.0, 0.0], [-9.0, -4.0, 0.0]]), (3, None)], "k long, gl array<array<double>>")
    found = {r.k: (r.ac, r.qual) for r in kernels.allele_counts(d, "k", "gl").collect()}
    assert found[1][0] == 0 and found[2][0] == 4 and found[2][1] > 30 and found[3] == (0, 0)


def test_denoised_against_svd(spark):
    rng = np.random.default_rng(5)
    normals, case = rng.normal(size=(4, 30)), rng.normal(size=(2, 30))
    rows = lambda x: spark.createDataFrame([(s, i, float(v)) for s, row in enumerate(x) for i, v in enumerate(row)], "s long, i long, v double")
    v = np.linalg.svd(normals, full_matrices=False)[2][:2].T
    want = case - case @ v @ v.T
    found = np.zeros(case.shape)
    for r in copynumber.denoised(rows(case), "s", "i", "v", rows(normals), 2).collect():
        found[r.s, r.i] = r.denoised
    assert np.allclose(found, want)


def test_quantised_levels():
    h = pd.DataFrame({"quality": [2, 10, 11, 30, 40], "n": [5, 100, 100, 1000, 10]})
    out = copynumber.quantised_levels(h, 3).set_index("quality")["quantised"]
    assert out[10] == out[11] and out.nunique() <= 3 and copynumber.quantised_levels(h, 9)["quantised"].tolist() == [2, 10, 11, 30, 40]


def test_mixture_scores(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(x), float(y), bool(i % 2)) for i, (x, y) in enumerate(rng.normal(size=(200, 2)) + np.array([[3 * (i % 2), 0] for i in range(200)]))]
    d = spark.createDataFrame([*rows, (999, None, 1.0, True)], "k long, x double, y double, good boolean")
    found = {r.k: r.lod for r in kernels.mixture_scores(d, ["k"], ["x", "y"], "good", 2).collect()}
    assert set(found) == set(range(200)) and np.mean([(found[i] > 0) == bool(i % 2) for i in range(200)]) > 0.9


def test_extensions(spark):
    d = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    extensions.forget("filter", "small")

    @extensions.register("filter", "small")
    def small():
        return F.col("k") < 2

    with pytest.raises(ValueError):
        extensions.register("filter", "small")(small)
    with pytest.raises(KeyError):
        extensions.filtered(d, ["unknown"])
    assert extensions.filtered(d, ["small"]).count() == 1 and extensions.filtered(d, ["not small"]).count() == 2
    with pytest.raises(Exception, match="ended with"):
        extensions.piped(d.select(F.col("k").alias("value")), ["false"]).count()


def test_stream_out_of_order_is_an_error(spark, tmp_path):
    from locusframe.streaming import streams

    spark.createDataFrame([(1, 5), (1, 4)], "u long, e long").coalesce(1).write.parquet(str(tmp_path / "x"))
    with pytest.raises(Exception, match="comes after"):
        streams.finished(streams.in_order(streams.table_stream(spark, str(tmp_path / "x")), "u", "e"), "bad")
