import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import scalars as S
from locusframe.operators import aggregates, filters, intervals, sites, transforms, windows
from locusframe.plans import catalog
from locusframe.sources import text


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(1)
    a = [(i, rng.choice("xy"), s := rng.randrange(60), s + rng.randrange(-2, 20)) for i in range(80)]
    b = [(i, rng.choice("xy"), s := rng.randrange(60), s + rng.randrange(-2, 20)) for i in range(80)]
    left, right = spark.createDataFrame(a, "k long, c string, s long, e long"), spark.createDataFrame(b, "k2 long, c2 string, s2 long, e2 long")
    want = sorted((x[0], y[0]) for x, y in itertools.product(a, b) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3] and x[2] <= x[3] and y[2] <= y[3])
    on = ("c", "s", "e"), ("c2", "s2", "e2")
    got = sorted((r.k, r.k2) for r in intervals.overlap_join(left, right, *on, 7).collect())
    assert got == want
    assert {r.k for r in intervals.overlap_join(left, right, *on, 7, "anti", "k").collect()} == {x[0] for x in a} - {k for k, _ in want}
    assert {(r.k, r.n_overlaps) for r in intervals.overlap_join(left, right, *on, 7, "count", "k").collect()} == {(x[0], sum(k == x[0] for k, _ in want)) for x in a}


def test_merge_edges(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("a", 20, 30), ("a", 22, 25), ("a", 31, 31)], "c string, s int, e int")
    assert sorted((r.s, r.e) for r in intervals.merge(d, "c", "s", "e").collect()) == [(1, 9), (20, 31)]
    assert sorted((r.s, r.e) for r in intervals.merge(d, "c", "s", "e", abutting=False).collect()) == [(1, 5), (6, 9), (20, 30), (31, 31)]


def test_scalars(spark):
    r = spark.range(1).select(S.half_up(F.lit(-2.5)).alias("h"), S.phred(F.lit(0.001)).alias("q"), S.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0))).alias("l"), S.reverse_complement(F.lit("AACG")).alias("r"), S.fisher_two_sided(F.lit(3), F.lit(1), F.lit(1), F.lit(3)).alias("f"), S.dust(F.lit("AAAAAA")).alias("d"), S.log1m_exp(F.lit(-1e-9)).alias("m")).first()
    assert (r.h, r.q, r.r) == (-2, 30, "CGTT")
    assert math.isclose(r.l, 1000 + math.log(2)) and math.isclose(r.f, 34 / 70, rel_tol=1e-6) and math.isclose(r.d, 6 / 3)
    assert math.isclose(r.m, math.log(1e-9), rel_tol=1e-6)


def test_duplicates_with_ties(spark):
    d = spark.createDataFrame([(1, "k", 5), (2, "k", 5), (3, "k", 4), (4, "z", 0)], "id long, k string, s int")
    out = windows.mark_duplicates(d, [F.col("k")], F.col("s"), F.col("id")).collect()
    assert {r.id for r in out if not r.duplicate} == {1, 4}


def test_near_rows_drop_whole_chains(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("a", 9, 3), ("a", 50, 4)], "c string, p int, k int")
    assert [r.k for r in windows.remove_near(d, "c", "p", "k", 4).collect()] == [4]


def test_sam_filters_and_transforms(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nr1/1\t99\tchr1\t10\t60\t4M\t=\t30\t24\tACGT\tIIII\tRG:Z:g\nr2\t1024\tchr1\t10\t255\t2S2M\t*\t0\t0\tACGN\t!!II\tRG:Z:g\n")
    reads = text.read_sam(spark, str(tmp_path / "a.sam"))
    assert [(r.end, r.read_group, r.quals) for r in reads.collect()] == [(13, "g", [40] * 4), (11, "g", [0, 0, 40, 40])]
    kept = lambda c: [r.name for r in reads.filter(c).collect()]
    assert kept(filters.PLAIN["not_duplicate"]()) == ["r1/1"]
    assert kept(filters.wellformed()) == ["r1/1", "r2"]
    assert kept(filters.PLAIN["mapping_quality_available"]()) == ["r1/1"]
    assert kept(filters.ambiguous_bases(0)) == ["r1/1"]
    r = reads.select(transforms.strip_mate_number(F.col("name")).alias("n"), transforms.mask_low_quality(F.col("bases"), F.col("quals"), 10).alias("b"), transforms.clip_ends(F.col("quals"), 15).alias("c")).collect()
    assert [(x.n, x.b, tuple(x.c)) for x in r] == [("r1", "ACGT", (1, 4)), ("r2", "NNGN", (3, 4))]


def test_bed_and_vcf(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#x\ntrack name=y\nchr1\t0\t5\tn\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 1, 5, "n", None, None)]
    (tmp_path / "a.vcf").write_text("##f\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t7\t.\tAC\tA,T\t1234567.89\tPASS\tDP=3;DB;DP=4;ANN=a=b\tGT:DP\t0/1:5\t.\nchr1\t8\t.\tA\t.\t1e3\t.\t.\tGT\t0|0\t0/0\n")
    v, w = text.read_vcf(spark, str(tmp_path / "a.vcf")).orderBy("start").collect()
    assert (v.start, v.end, v.alts, v.qual, v.filters, v.info) == (7, 8, ["A", "T"], 1234567.89, [], {"DP": "3", "DB": None, "ANN": "a=b"})
    assert [(g.sample, g["values"]) for g in v.genotypes] == [("s1", {"GT": "0/1", "DP": "5"}), ("s2", {"GT": None})]
    assert (w.alts, w.qual, w.filters, w.info) == ([], 1000.0, None, {})


def test_cigars(spark):
    c = spark.createDataFrame([("5M10N2D20N3M",), ("2S1N1D1N1D1N3M",), ("4M",), (None,)], "c string")
    r = c.select(transforms.collapse_ndn(F.col("c")).alias("n"), transforms.cigar_lengths(F.col("c")).alias("l"), transforms.invert_cigar(F.col("c")).alias("i")).collect()
    assert [x.n for x in r] == ["5M32N3M", "2S3N1D1N3M", "4M", None]
    assert tuple(r[1].l) == (5, 8, 2) and r[0].i == "3M20N2D10N5M"


def test_clipping_and_masks(spark):
    d = spark.createDataFrame([("ACGTAAGG", [1, 2, 3, 4, 5, 6, 7, 8]), ("AC", [1, 2]), ("", [])], "b string, q array<int>")
    r = d.select(transforms.clip_to(F.col("b"), F.col("q"), F.lit(2), F.lit(3)).alias("c"), transforms.trim_adapter(F.col("b"), ["AAGGTT", "CCCC"], 0, 3).alias("t"), transforms.mask_simple_repeats(F.col("b"), 4, 4, 4).alias("m")).collect()
    assert [tuple(x.c) for x in r] == [("CG", [2, 3]), ("C", [2]), ("", [])]
    assert [x.t for x in r] == ["ACGT", "AC", ""]
    assert [x.m for x in r] == ["ACGTAAGG", "AC", ""]
    tie = spark.createDataFrame([([20, 15, 30],), ([5, 5, 40],)], "q array<int>").select(transforms.clip_ends(F.col("q"), 15).alias("c")).collect()
    assert [tuple(x.c) for x in tie] == [(1, 3), (3, 3)]


def test_empirical_quality_against_enumeration(spark):
    def brute(errors, n, reported):
        def score(q):
            shift = abs(int(q - reported))
            if q == 0 or shift >= 20:
                return -1e300 * ((q == 0) + (shift >= 20))
            p = 10 ** (-q / 10)
            return math.log10(0.9 * math.exp(-shift * shift / 0.5)) + (errors + 1) * math.log10(p) + (n + 1 - errors) * math.log10(1 - p)

        return max(range(61), key=lambda q: (score(q), -q))

    cases = [(0, 0, 30.0), (5, 100, 30.0), (1000, 1_000_000, 20.5), (3, 3, 10.0), (0, 10_000_000, 40.0), (1, 10, 93.0)]
    got = spark.createDataFrame(cases, "e long, n long, r double").select(sites.empirical_quality(F.col("e"), F.col("n"), F.col("r")).alias("q")).collect()
    assert [int(x.q) for x in got] == [brute(*c) for c in cases]


def test_excess_het_against_enumeration(spark):
    def brute(rr, ra, aa):
        n, rare = rr + ra + aa, min(2 * rr + ra, 2 * aa + ra)
        if rare <= 1:
            return -10 * math.log10(0.5)
        w = {h: math.exp(h * math.log(2) + math.lgamma(n + 1) - math.lgamma(h + 1) - math.lgamma((rare - h) / 2 + 1) - math.lgamma(n - h - (rare - h) / 2 + 1)) for h in range(rare % 2, rare + 1, 2)}
        return -10 * math.log10((sum(x for h, x in w.items() if h > ra) + w[ra] / 2) / sum(w.values()))

    cases = [(10, 0, 0), (5, 1, 0), (10, 5, 2), (0, 12, 0), (3, 9, 3), (40, 3, 30)]
    got = spark.createDataFrame(cases, "a long, b long, c long").select(sites.excess_het(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()
    assert np.allclose([x.x for x in got], [brute(*c) for c in cases], atol=1e-6)


@pytest.mark.parametrize("k", [1, 6, 7, 12])
def test_kmer_counts(spark, k, monkeypatch):
    monkeypatch.setattr(aggregates, "STARTS", 50)
    rng = random.Random(k)
    rows = [None, "", "a", "zzzzzz"] + ["".join(rng.choice("abz") for _ in range(rng.randrange(60))) for _ in range(200)]
    want = Counter(t[i : i + k] for t in rows if t for i in range(len(t) - k + 1))
    d = spark.createDataFrame([(t,) for t in rows], "t string")
    assert {r.kmer: r.n for r in aggregates.kmer_counts(d, F.col("t"), k).collect()} == want
    assert aggregates.kmer_counts(d.limit(0), F.col("t"), k).count() == 0


def test_kmer_count_documents(spark):
    """All k-mers of documents, against a plain count."""
    small = "/root/testdata/sf0.001"
    texts = [re.sub("[^a-z]", "", r.text.lower()) for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() if r.text]
    want = Counter(t[i : i + 6] for t in texts for i in range(len(t) - 5))
    assert {r.kmer: r.n for r in catalog.QUERIES["kmer_count_documents"](spark, small).collect()} == {x: n for x, n in want.items() if n > 1}


def test_active_regions_against_a_loop(spark):
    rng = random.Random(11)
    rows = [(g, t, float(rng.choice([0, 1, 2, 3, 3, 4]) if g < 2 else rng.choice([2, 3, 4]))) for g in range(3) for t in range(70)]

    def plain(values, threshold, least, longest):
        out, begin = [], 0
        while begin < len(values):
            active, n = values[begin] > threshold, 0
            while begin + n < len(values) and n < longest and (values[begin + n] > threshold) == active:
                n += 1
            if active and n == longest:
                low = [i for i in range(least - 1, n) if i >= 1 and begin + i + 1 < len(values) and values[begin + i] <= values[begin + i + 1] and values[begin + i] < values[begin + i - 1]]
                if low:
                    n = max(i for i in low if values[begin + i] == min(values[begin + j] for j in low)) + 1
            out.append((begin, begin + n - 1, active, n))
            begin += n
        return out

    d = spark.createDataFrame(rows, "k long, t long, v double")
    for least, longest in ((2, 5), (1, 9)):
        found = windows.active_regions(d, "k", "t", "v", 1.0, least, longest).collect()
        for g in range(3):
            want = plain([v for k, _, v in rows if k == g], 1.0, least, longest)
            assert sorted((r.start, r.end, r.active, r.n) for r in found if r.k == g) == want
