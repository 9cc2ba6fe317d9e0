"""Tools and binary files against plain Python."""

import gzip
import re
import struct

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from locusframe import tools
from locusframe.functions import joins
from locusframe.operators import filters, intervals, readsets, variants
from locusframe.plans import reads as view
from locusframe.sources import bam, shared, text

SMALL = "/root/testdata/sf0.001"


def masked(bases, window=15, least=14):
    hit = set()
    for i in range(max(1, len(bases) - window + 1)):
        part = bases[i : i + window]
        if sum(c in "ATNatn" for c in part) >= least or sum(c in "GCNgcn" for c in part) >= least:
            hit |= set(range(i, i + window))
    return "".join("N" if i in hit else c for i, c in enumerate(bases))


def cut(quals, threshold=15):
    def best(xs):
        total, top, at = 0, 0, 0
        for i, q in enumerate(xs, 1):
            total += threshold - q
            if total >= top:
                top, at = total, i
        return at

    right = best(quals[::-1])
    left = best(quals[: max(len(quals) - right, 0)])
    return left + 1, len(quals) - right


def test_host_subtraction(spark):
    rows = view.reads(spark, SMALL).collect()
    host = {r.bases[i : i + 9] for r in rows if r.k % 3 == 0 for i in range(len(r.bases) - 8) if r.bases[i] == "A"}
    left = {}
    for r in rows:
        if r.flags & 0x900:
            continue
        bases = masked(r.bases) if r.bases else r.bases
        first, last = cut(r.quals)
        bases, quals = bases[first - 1 : max(last, first - 1)], r.quals[first - 1 : max(last, first - 1)]
        if len(bases) < 8:
            continue
        bases = "".join("N" if i < len(quals) and quals[i] < 15 else c for i, c in enumerate(bases))
        if len(re.sub("[ACGT]", "", bases)) > 2 or sum(bases[i : i + 9] in host for i in range(len(bases) - 8)) >= 1:
            continue
        key = min(bases, bases.translate(str.maketrans("ACGT", "TGCA"))[::-1])
        if key not in left or r.k < left[key][0]:
            left[key] = (r.k, re.sub(r"/[12]$", "", re.sub(r"\s.*$", "", r.name)), bases)
    found = sorted(tuple(x) for x in entry.queries()["host_subtraction"](spark, SMALL).collect())
    assert found == sorted(left.values()) and len(found) > 5


def test_bam_is_a_gzip_stream_of_records(spark, tmp_path):
    d = spark.createDataFrame([("b", 0, "c2", 5, 60, [(4, "M")], None, 0, 0, "ACGN", [30, 31, 32, 33], {"NM": "1"}), ("a", 16, "c1", 9, 7, [(2, "S"), (3, "M")], "c1", 2, -9, "ACGTA", None, {}), ("u", 4, None, 0, 0, [], None, 0, 0, "", [], None)], bam.SCHEMA)
    bam.write_bam(d, str(tmp_path / "x"), [("c1", 100), ("c2", 200)], parts=1)
    raw = gzip.decompress(next((tmp_path / "x").glob("*.bam")).read_bytes())
    n = struct.unpack("<i", raw[4:8])[0]
    assert raw[:4] == b"BAM\1" and b"@SQ\tSN:c2\tLN:200" in raw[8 : 8 + n] and struct.unpack("<i", raw[8 + n : 12 + n])[0] == 2
    found = bam.read_bam(spark, str(tmp_path / "x")).collect()
    assert [(r.name, r.contig, r.start, r.end, r.bases, r.quals, r.tags) for r in found] == [("a", "c1", 9, 11, "ACGTA", None, {}), ("b", "c2", 5, 8, "ACGN", [30, 31, 32, 33], {"NM": "1"}), ("u", None, 0, -1, "", [], {})]
    assert (found[0].mate_contig, found[0].mate_start, found[0].tlen) == ("c1", 2, -9)
    (tmp_path / "bad.bam").write_bytes(gzip.compress(b"nothing"))
    with pytest.raises(Exception, match="not a binary"):
        bam.read_bam(spark, str(tmp_path / "bad.bam")).collect()


def test_sam_with_odd_lines(spark, tmp_path):
    long = "x" * (1 << 20) + "end"
    (tmp_path / "a.sam").write_text(f"r1\t0\tchr1\t1\t9\t3M\t*\t0\t0\tACG\t*\tXX:Z:{long}\tXX:Z:second\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    a, b = text.read_sam(spark, str(tmp_path / "a.sam")).orderBy("name").collect()
    assert a.quals is None and a.tags == {"XX": long} and (b.bases, b.cigar, b.contig) == ("", [], None)


def test_filters_never_fail_on_reads_without_cigar(spark):
    r = view.reads(spark, SMALL).filter("cigar_text = '*'")
    assert filters.kept_by(r, {n: f() for n, (f, _) in view.FILTERS.items()}, "k").count() == len(view.FILTERS)


def test_null_safe_join_and_sizes(spark):
    a, b = spark.createDataFrame([(None, 1), (1, 2)], "k long, x long"), spark.createDataFrame([(None, "n"), (1, "o")], "k long, y string")
    assert sorted((r.x, r.y) for r in joins.null_safe(a, b, ["k"]).collect()) == [(1, "n"), (2, "o")]
    assert joins.is_small(spark.range(9)) and not joins.is_small(spark.range(10**9), 1 << 20) and not joins.is_small(a)  # no statistics: not known to be small


def test_wide_and_narrow_intervals_meet_once(spark):
    """Levels: intervals of very different widths, negative places, each strategy."""
    left = [(i, "c", s, s + w) for i, (s, w) in enumerate([(-50, 3), (0, 0), (10, 5000), (400, 90), (-20_000, 40_000), (4999, 2)])]
    right = [(i, "c", s, s + w) for i, (s, w) in enumerate([(-49, 1), (0, 100_000), (5, 5), (12, 1), (4000, 3000), (-30_000, 5)])] + [(9, "c", 5, 4)]
    a, b = spark.createDataFrame(left, "k long, c string, s long, e long"), spark.createDataFrame(right, "k2 long, c2 string, s2 long, e2 long")
    want = sorted((x[0], y[0]) for x in left for y in right if x[2] <= y[3] and y[2] <= x[3] and y[2] <= y[3])
    for strategy in intervals.STRATEGIES:
        found = intervals.overlapping_pairs(a, b, ("c", "s", "e"), ("c2", "s2", "e2"), "k", "k2", 4, strategy)
        assert sorted(map(tuple, found.collect())) == want, strategy
    assert sorted(map(tuple, intervals.overlap_join(a, b, ("c", "s", "e"), ("c2", "s2", "e2"), 4, strategy="shuffle", salt=3).select("k", "k2").collect())) == want
    with pytest.raises(Exception, match="longer than"):
        intervals.no_longer_than(a, "s", "e", 100).count()


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared.shared_folder(Session())


def test_genotypes_and_orders(spark):
    d = spark.createDataFrame([("c", 1, "A", ["T", "G"], [("b", {"GT": "0/2", "AD": "5,1,3", "PL": "9,8,7,0,6,5"}), ("a", {"GT": "1|0"})])], "contig string, start int, ref string, alts array<string>, genotypes array<struct<sample:string,values:map<string,string>>>")
    one = variants.subset_alleles(d, F.array(F.lit(2))).first()
    assert one.alts == ["G"] and one.genotypes[0]["values"] == {"GT": "0/1", "AD": "5,3", "PL": "9,0,5"} and one.genotypes[1]["values"]["GT"] == ".|0"
    assert [g.sample for g in variants.fixed_sample_order(d, ["a", "b"]).first().genotypes] == ["a", "b"]
    rows = spark.createDataFrame([(1, "z", 5, 0, "n"), (2, "a", 1, 0, "n"), (3, None, 0, 4, "n")], "k long, contig string, start int, flags int, name string")
    assert [r.k for r in readsets.sort_by_coordinate(rows, ["z", "a"], "k").collect()] == [1, 2, 3]


def test_recalibrated_qualities_revert(spark):
    d = spark.createDataFrame([(1, [5], {"OQ": "I"}), (2, [6], {})], "k long, quals array<int>, tags map<string,string>")
    assert [r.quals for r in tools.revert_base_quality_scores(d).orderBy("k").collect()] == [[40], [6]]


def test_scratch_is_cleared(spark, monkeypatch):
    import os

    monkeypatch.setattr(shared, "_named", [])
    kept = shared.stored(spark.range(5), "numbers")
    path = shared._named[0].removeprefix("file:")
    assert kept.count() == 5 and os.path.isdir(path)
    assert shared.clear(spark) == 1 and not os.path.exists(path)
