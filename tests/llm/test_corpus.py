"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from locusframe.llm import bpe, components, langid, licences, lm, near, packing, quality, suffixes, topk, toxicity, vocabulary

RNG = random.Random(7)
WORDS = ["the", "sea", "of", "Stones", "ever", "ünder", "night", "glass", "x1", "river,", "Q", "ash."]


def prose(n):
    return " ".join(RNG.choice(WORDS) + str(RNG.randrange(40) or "") for _ in range(n))


PASSAGE = prose(60)
BASE = prose(120)
TEXTS = [
    None, "", " \n\t ", "one two", "one two", "a b c d e", BASE, BASE, BASE + " tail", BASE.replace("the", "THE"), prose(40) + " " + PASSAGE + " " + prose(30),
    PASSAGE + prose(5), prose(10) + PASSAGE, "x" * 300, "x" * 120, "é" * 80, "日本語 テキスト ½ ²  \n\n end\r\n", prose(3000), prose(3000) + " " + BASE,
    "Line one here.\nLine one here.\nAll rights reserved.\n", "<|endoftext|> it's 12 o'clock   ok", "\x1c odd \x85 space\xa0here", "a <|endoftext|>b<|endoftext|><|endoftext|> <|endoftext",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, i * 10, "clash") for i, t in enumerate(TEXTS)] + [(None, BASE, "en", 1, "c"), (7, BASE, "en", 2, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rid long, pid string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def given(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_bpe_is_the_librarys(docs, empty):
    ranks = vocabulary.ranks(vocabulary.rank_file())
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d if d is not None else -1, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in given(docs))
    got = sorted((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in bpe.encode_decode(docs).collect())
    assert got == want
    assert bpe.encode_decode(empty).count() == 0


def test_vocabulary_forms_agree():
    assert vocabulary.ranks(vocabulary.json_file()) == vocabulary.ranks(vocabulary.rank_file())


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(vocabulary.json_file())
    pieces = packing.pack(docs).collect()
    want = Counter()
    for d, t in given(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(p.length for p in pieces) == sum(n * k for (_, n, _), k in want.items())
    unique = {d: (n, c) for (d, n, c), k in want.items() if k == 1 and sum(e == d for e, _, _ in want) == 1}
    texts = dict(given(docs))
    for d, (n, _) in unique.items():
        ids, at = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 0], 0
        for p in sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, n) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == n
    assert packing.pack(empty).count() == 0


def test_best_cuts_against_all_cuts():
    rng = random.Random(3)
    for _ in range(30):
        points = [0, *sorted(rng.sample(range(1, 40), 8)), 40]
        costs = [0, *[rng.randrange(5) for _ in points[1:]]]
        limit = max(b - a for a, b in zip(points, points[1:])) + rng.randrange(1, 12)

        def cost(cuts):
            at, total = 0, 0
            for j in cuts:
                n = points[j] - at
                if n > limit:
                    return math.inf
                total += (0 if n >= 64 and n & (n - 1) == 0 else limit - n) + costs[j] + packing.WINDOW
                at = points[j]
            return total

        inner = range(1, len(points) - 1)
        least = min(cost([*[j for k, j in enumerate(inner) if m >> k & 1], len(points) - 1]) for m in range(1 << len(inner)))
        assert cost(packing.best_cuts(points, costs, limit)) == least


def test_suffix_dedup(docs, empty):
    rows = given(docs)
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for j in range(len(raw) - 49):
            if d is not None:
                least[raw[j : j + 50]] = min(least.get(raw[j : j + 50], d), d)
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for j in range(len(raw) - 49):
            if d is not None and least[raw[j : j + 50]] < d:
                gone[j : j + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d if d is not None else -1, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffixes.dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffixes.dedup(empty).count() == 0


def test_suffix_dedup_tells_apart_high_bytes_of_words(spark):
    base = bytearray(b"stock item 0000 of the northern store, third shelf")
    assert len(base) == suffixes.LENGTH
    made = []
    for a in range(65, 91):
        for b in range(65, 91):
            base[7], base[15] = a, b
            made.append(bytes(base))
    rows = [(i, x.decode()) for i, x in enumerate(made)] + [(len(made), made[3].decode())]
    found = {r.doc_id: r.n_removed for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: suffixes.LENGTH if i == len(made) else 0 for i in range(len(rows))}


def in_buckets(documents, n, splitters, frequent, monkeypatch):
    """dedup's steps without Spark: two blocks of documents, n buckets, these splitters and frequent leads."""
    told = SimpleNamespace(value=(splitters, frequent))
    steps = []
    for task in (0, 1):
        monkeypatch.setattr(suffixes, "task_id", lambda task=task: task)
        half = documents[task::2]
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in half], pa.int64()), pa.array([t for _, t in half], pa.binary())], names=["doc_id", "text"])
        steps += suffixes._send(n, told)(iter([batch]))
    for stage in (suffixes._answer(n), suffixes._cut(n, told, ())):
        sent = pa.Table.from_batches(steps)
        steps = [b for k in range(n) for b in stage(iter(sent.filter(pc.equal(sent.column("pid"), k)).to_batches()))]
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept"]) for b in steps for r in b.to_pylist())


@pytest.mark.parametrize("block", [suffixes.BLOCK, 400])
def test_suffix_dedup_in_buckets_against_brute_force(block, monkeypatch):
    """Copies, periods and passages over several buckets; leads declared frequent at random; blocks sorted in several parts."""
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "STRINGS", 100)
    rng = random.Random(block)
    words = [bytes(rng.choices(b"abcdefghij", k=rng.randrange(2, 7))) for _ in range(60)]
    text = lambda n: b" ".join(rng.choices(words, k=n))
    for _ in range(12):
        passages = [text(rng.randrange(8, 40)) for _ in range(4)]
        made = []
        for _ in range(40):
            own = text(rng.randrange(30)) + rng.choice(passages)[rng.randrange(8) :] + text(rng.randrange(20))
            own = rng.choice([own] * 8 + [b"x" * rng.randrange(300), b"ab" * rng.randrange(90), rng.choice(made)[1] if made else b""])
            made.append((rng.randrange(60), own))
        whole = np.frombuffer(b"".join(t for _, t in made), np.uint8)
        leads = suffixes.records(whole, *suffixes.chosen(whole, np.cumsum([0] + [len(t) for _, t in made])))[:, : suffixes.LEAD]
        order, new = suffixes.multikey(leads, suffixes.LEAD)
        assert [tuple(x) for x in leads[order].tolist()] == sorted(tuple(x) for x in leads.tolist())
        leads = leads[order]
        frequent = leads[np.flatnonzero(new)][rng.randrange(3) :: rng.choice([3, 1000])]
        least = {}
        for d, t in made:
            for j in range(len(t) - 49):
                least[t[j : j + 50]] = min(least.get(t[j : j + 50], d), d)
        want = []
        for d, t in made:
            gone = np.zeros(len(t), bool)
            for j in range(len(t) - 49):
                gone[j : j + 50] |= least[t[j : j + 50]] < d
            want.append((d, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
        assert in_buckets(made, 4, leads[np.arange(1, 4) * len(leads) // 4], frequent, monkeypatch) == sorted(want)


def test_suffix_records_are_sent_whole():
    data = np.frombuffer((prose(400) + "\0" * 90 + prose(20)).encode(), np.uint8)
    words = suffixes.records(data, *suffixes.chosen(data, np.array([0, len(data)])))
    words = words[suffixes.multikey(words, suffixes.WORDS)[0]]
    assert (suffixes.restored(*suffixes.shortened(words)) == suffixes.as_bytes(words)).all()


def test_suffix_dedup_of_a_long_text(spark):
    """A text longer than a block (and so sorted in parts), with a copy of itself; passages lie over the borders of pieces."""
    rng = np.random.default_rng(9)
    long = rng.integers(97, 123, suffixes.BLOCK * 2 + 77, dtype=np.uint8).tobytes().decode()
    rows = [(1, long), (2, long[5:-5]), (3, "q" + long[suffixes.PIECE - 30 : suffixes.PIECE + 30] + "q"), (4, long[:49])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n) for r in suffixes.dedup(d).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n")).collect()}
    assert found == {1: (len(long), 0, 0), 2: (len(long) - 10, len(long) - 10, 1), 3: (62, 60, 1), 4: (49, 0, 0)}


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_copies(docs, empty):
    rows = [(d, shingles(t)) for d, t in given(docs)]
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, a in rows:
        for e, b in rows:
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(d), root(e)))
                up[y] = x
    want = sorted((d if d is not None else -1, len(s), root(d) if d is not None else -1) for d, s in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in near.join(docs).collect())
    assert got == want
    assert near.join(empty).count() == 0


def test_near_copies_of_many_sizes(spark):
    """A chain of texts, each a few edits from the one before, in one group though its ends are far apart."""
    w = prose(200).split()
    rows = []
    for i in range(40):
        w = w.copy()
        w[RNG.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame([*rows, *[(100 + i, prose(80)) for i in range(20)]], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near.join(d).collect()}
    assert {found[i] for i in range(40)} == {0} and all(found[100 + i] == 100 + i for i in range(20))


def test_near_copies_at_the_threshold(spark):
    """A large group of texts that differ by about as much as links allow, in random places: some link, some don't."""
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(120)], []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((0, 1, 2, 3, 4, 5, 6))):
            words[at] = f"x{i}y{at}" if rng.random() < 0.7 else f"z{at}"
        texts.append(" ".join(words[: rng.randint(95, 120)]))
    sets, up = [shingles(t) for t in texts], list(range(150))
    for i in range(150):
        for j in range(i):
            if up[i] != up[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    assert 1 < len(set(up)) < 150
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.join(d).collect()} == dict(enumerate(up))


def test_bound_holds():
    rng = np.random.default_rng(5)
    for n, m in ((5, 9), (300, 340), (900, 1100), (30000, 35000)):
        a, b = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)), np.unique(rng.integers(0, 2**63, m, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], b]))
        assert near.overlap_bound(near.bitmap(a), near.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "u long, v long")
    assert sorted((r.node, r.component) for r in components.components(links).collect()) == [(2, 1), (3, 1), (7, 1), (8, 1), (9, 1), (21, 20)]
    assert components.components(links.limit(0)).count() == 0


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    """A chain over many tasks: the steps and the one task that ends them agree; without many links there are no steps."""
    chain = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 101 + i) for i in range(20)]
    random.Random(3).shuffle(chain)
    links = spark.createDataFrame([*chain, (5, None), (None, 6)], "u long, v long").repartition(8)
    want = sorted([(i, 0) for i in range(1, 61)] + [(100 + i, 100) for i in range(1, 21)])
    context = spark.sparkContext
    context.setJobGroup("few links", "components of few links")
    got = sorted(map(tuple, components.components(links).collect()))
    jobs = len(context.statusTracker().getJobIdsForGroup("few links"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and jobs <= 8
    monkeypatch.setattr(components, "FOREST", 0)
    assert sorted(map(tuple, components.components(links).collect())) == want


def test_written_tables_are_cleared(spark):
    import os

    from locusframe.llm import blocks

    one, two = (blocks.written(spark.range(3), "x") for _ in range(2))
    paths = [x.written_to.removeprefix("file:") for x in (one, two)]
    blocks.discard(one)
    assert not os.path.exists(paths[0]) and two.count() == 3
    blocks.clear(spark)
    assert not os.path.exists(paths[1]) and not blocks._kept


def test_lm_scores(docs, empty):
    rows = [(d, (t or "").encode().lower().split()) for d, t in given(docs)]
    count = Counter(tuple(w[i : i + n]) for _, w in rows for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in rows)
    want = []
    for d, w in rows:
        own = Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
        c = lambda g: count[tuple(g)] - own[tuple(g)]

        def s(i, n):
            g = w[i - n + 1 : i + 1]
            if n == 1:
                return c(g) / (total - len(w)) if c(g) else 1 / (total - len(w) + 1)
            return c(g) / c(g[:-1]) if c(g) else 0.4 * s(i, n - 1)

        want.append((d if d is not None else -1, len(w), round(sum(math.log(s(i, min(3, i + 1))) for i in range(len(w))), 6)))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_words, round(r.log_score, 6)) for r in lm.score(docs).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=1e-4)
    assert lm.score(empty).count() == 0


def test_quality(docs, empty):
    labels = docs.sparkSession.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    for r in quality.judge(docs, labels).collect():
        w = (dict(given(docs)).get(r.doc_id) if r.doc_id is not None else BASE) or ""
        w = w.encode().split()
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), len(covered), sum(len(x.decode()) for x in w))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality.judge(empty, labels.limit(0)).count() == 0


def test_binomial(spark):
    r = spark.range(1).select(quality.binomial(F.lit(3).cast("long"), F.lit(20).cast("long"), 0.1).alias("p")).first()
    assert math.isclose(r.p, sum(math.comb(20, i) * 0.1**i * 0.9 ** (20 - i) for i in range(4)))


def test_cutoffs_limit_false_rejection(spark):
    """2,000 good texts, 1 in 10 of them with many marks, more than the allowed share: no cutoff may reject those."""
    rows = [(i, " ".join(["plain"] * 3 + [f"w{i}x{j}" + ("!!" if i % 10 == 0 else "") for j in range(60)]), "en") for i in range(2000)] + [(5000 + i, " ".join(f"v{i}x{j}!!!!!" for j in range(60)), "en") for i in range(50)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(d, spark.createDataFrame([(i, 1) for i in range(2000)], "doc_id long, quality int")).collect()}
    assert all(kept[i] for i in range(2000)) and not any(kept[5000 + i] for i in range(50))


def test_verdicts_against_brute_force(spark):
    """Two languages, one with too few labels; copies of a labelled text are one trial; the verdict of every text by the stated method."""
    rng = random.Random(8)
    rows = []
    for i in range(700):
        marks, symbols = rng.choice([0] * 20 + [1]), rng.choice([0] * 30 + [1, 1, 2])
        words = [f"w{i}x{j}" + "!" * (marks and rng.randrange(3)) + "#" * (symbols and rng.randrange(symbols + 1)) for j in range(rng.randrange(45, 80))]
        rows.append((i, " ".join(words), "few" if i % 10 == 0 else "many"))
    rows += [(1000 + i, rows[1][1] + "", "many") for i in range(300)] + [(2000, None, "many"), (2001, "", None)]
    labels = {i: int(rng.random() < 0.7) for i in range(2002)}

    def figures(text):
        w, ls = (text or "").split(), [x for x in (text or "").split("\n") if x.strip()]
        n, chars, symbols, marks = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), sum(c in "!?" for c in text or "")
        return n, {"symbols": 100 * symbols, "repeats": 0, "lines": (100 * (len(ls) - len(set(ls))) // max(len(ls), 1)) * n, "long": 100 * chars, "short": -100 * chars, "marks": 100 * marks}

    def first(text):
        n, f = figures(text)
        if n < 50:
            return None
        value = {k: int(x / n) for k, x in f.items()}
        return min([i for i, (rule, c) in enumerate(quality.STEPS) if value[rule] > c], default=len(quality.STEPS))

    taken = {}
    for lang in ("few", "many"):
        held = {t: first(t) for d, t, x in rows if x == lang and labels[d] and first(t) is not None}
        taken[lang] = 0
        for i in range(len(quality.STEPS)):
            k, n = sum(x <= i for x in held.values()), len(held)
            p = sum(math.comb(n, j) * quality.RISK**j * (1 - quality.RISK) ** (n - j) for j in range(k + 1)) if k < n * quality.RISK else 1
            if p > quality.DELTA / 3:
                break
            taken[lang] = i + 1
    assert taken["few"] == 0 and 0 < taken["many"] < len(quality.STEPS)
    want = {d: first(t) is not None and first(t) >= taken.get(x, 0) for d, t, x in rows}
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality.judge(d, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    assert {r.doc_id: r.kept for r in found} == want and 0 < sum(not r.kept and not r.base_failed for r in found)
    steps = quality.certified(quality.features(d).withColumn("step", F.when(~F.col("base_failed"), F.expr(quality.first_step()))), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))
    assert {r.stratum: r.steps for r in steps.collect()} == taken
    limits = {r.stratum: r for r in quality.cutoffs(steps).collect()}
    assert all(limits["many"][rule] == min([c for r, c in quality.STEPS[: taken["many"]] if r == rule], default=None) for rule in quality.RULES)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).round(1).astype(float).tolist(), 0) for i in range(300)] + [(500, None, 0), (550, [None] * 8, 0), (600, [float("nan")] * 8, 0), (650, [0.5] * 8, 1), (651, [0.5] * 8, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if v and None not in v and not np.isnan(v).any()}
    want = [(q, r + 1, i, s) for q in x if q % 50 == 0 for r, (s, i) in enumerate(sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5])]
    got = [(r.query_id, r["rank"], r.vec_id, -r.score) for r in topk.top_k(d).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(d.limit(0)).count() == 0 and topk.top_k(d.filter("vec_id % 50 <> 0")).count() == 0


def test_top_k_of_repeated_ids_lengths_and_clashing_columns(spark):
    """Rows of one id are candidates for each other; a third of all rows has one vector; other lengths are apart; columns named as inner ones."""
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 120)), rng.normal(0, 40, 6).tolist() if i % 3 else [1.0] * 6) for i in range(400)] + [(50, [1.0, 2.0]), (51, [-1.0, 3.0]), (100, [2e4, -2e4]), (None, [1.0, 1.0])]
    d = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, block int, kind int, n string").repartition(3)
    x = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None]
    want = []
    for a, (q, v) in enumerate(x):
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for b, (i, w) in enumerate(x) if b != a and len(w) == len(v))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = [tuple(r) for r in topk.top_k(d).collect()]
    assert sorted(got) == sorted(want)
    with pytest.raises(Exception, match="or more"):
        topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [0.1])], "vec_id long, embedding array<double>")).collect()


def test_digits_and_skipped_blocks():
    for q in [*range(-70, 71), 2**24 + 5, -(2**25) + 1]:
        own = topk.digits(q)
        assert sum(s << p if s > 0 else -(1 << p) for p, s in own) == q and all(b[0] - a[0] > 1 for a, b in itertools.pairwise(own))
    rng = np.random.default_rng(3)
    values, queries = rng.integers(-300, 300, (77, 5)), rng.integers(-300, 300, (20, 5))
    index, low = topk.slices(values)
    raw = b"".join(s.to_bytes(10, "little") for own in index for s in own)
    block = topk.Block(77, np.arange(77).tobytes(), low.tobytes(), np.array([len(x) for x in index], np.uint8).tobytes(), raw)
    exact = queries @ values.T
    assert (block.bounds(queries) >= exact.max(1)).all()
    for q, own in zip(queries, exact):
        assert sorted(block.best(q, 4, 3), reverse=True) == sorted(((int(s), i) for i, s in enumerate(own) if i != 3), reverse=True)[:4]


def test_licences(docs, empty):
    found = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert found[19].licence == "Proprietary" and found[19].dice == 1 and found[19].n_found == 1
    start, length = found[19].found[0].start, found[19].found[0].length
    assert TEXTS[19].encode()[start : start + length].decode() == "All rights reserved."
    assert all(found[i].licence is None for i in (0, 1, 2, 6, 13))
    assert licences.scan(empty).count() == 0


def words_of(text):
    return re.findall("[a-z0-9]+", text.lower())


def test_licences_over_several_lines_or_within_one(spark):
    wrap = lambda t: "\n".join(textwrap.wrap(t, 60))
    header, inline = licences.TEMPLATES["Apache-2.0-header"], "This project is open source and is Licensed under the Apache License, Version 2.0. Contributions are welcome."
    cases = {
        0: ("MIT", wrap("MIT License Copyright (c) 2020 A. Person " + licences.LICENCES["MIT"])),
        1: ("Apache-2.0", inline),
        2: ("Apache-2.0-header", prose(300) + "\n# " + wrap(header).replace("\n", "\n# ") + "\n" + prose(300)),
        3: ("BSD-3-Clause", prose(200) + " " + wrap(licences.LICENCES["BSD-3-Clause"].replace("copyright holder nor", "author nor")) + " " + prose(200)),
        4: ("MIT-permission", prose(100) + "\n" + wrap(licences.TEMPLATES["MIT-permission"]) + "\n" + prose(100)),
        5: (None, prose(900)),
        6: ("AGPL-3.0-header", prose(150) + "\n" + wrap(licences.LICENCES["AGPL-3.0-header"]) + "\n" + prose(150)),
        7: ("Zlib", "/*\n * " + wrap(licences.LICENCES["Zlib"]).replace("\n", "\n * ") + "\n */\n" + prose(200)),
        8: ("LGPL-2.1-header", prose(90) + " " + licences.LICENCES["LGPL-2.1-header"] + " " + prose(90)),
        9: ("0BSD", wrap(licences.LICENCES["0BSD"])),
    }
    found = {r.doc_id: r for r in licences.scan(spark.createDataFrame([(i, t) for i, (_, t) in cases.items()], "doc_id long, text string")).collect()}
    for i, (name, text) in cases.items():
        names = {x.licence for x in found[i].found}
        assert name in names if name else not names, (i, names)
    (x,) = found[1].found
    assert inline.encode()[x.start : x.start + x.length] == b"Licensed under the Apache License, Version 2.0" and x.dice == 1


def test_licence_runs_against_brute_force(spark):
    rng = random.Random(3)
    templates = {"a": "one two three four five six", "b": "one two three four five seven", "c": "six one six one six two", "d": "two three"}
    sets = {k: set(itertools.pairwise(words_of(t))) for k, t in templates.items()}
    made = [" ".join(rng.choice([rng.choice(list(templates.values())), *"one two three six x y z".split()]) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows, want, line = [], {}, {}
    for i, text in enumerate(made):
        ws = words_of(text)
        text = "".join(w + rng.choice([" ", "\n", ", "]) for w in ws)
        rows.append((i, text))

        def match(words, names=templates):
            own = set(itertools.pairwise(words))
            return [(2 * len(own & sets[k]) / (len(own) + len(sets[k])), k) for k in names if own and 2 * len(own & sets[k]) / (len(own) + len(sets[k])) >= 0.8]

        places = [n for n, a in enumerate(text.split("\n")) for _ in words_of(a)]
        segments = [(d, k, n) for n, a in [(None, text), *enumerate(text.split("\n"))] for d, k in sorted(match(words_of(a)), key=lambda x: (-x[0], x[1]))[:1]]
        windows = [(-d, k, j, len(words_of(t)) - 1) for k, t in templates.items() for j in range(len(ws) - len(words_of(t)) + 1) for d, _ in match(ws[j : j + len(words_of(t))], [k])]
        used, chosen = set(), []
        for d, k, j, n in sorted(windows):
            if 2 * len(used & {*range(j, j + n)}) < n:
                used |= {*range(j, j + n)}
                within = [(e, m) for e, m, at in segments if at is None or {at} == set(places[j : j + n + 1])]
                if not any(m == k or e >= -d for e, m in within):
                    chosen.append((-d, k))
        tops = [(-d, k) for d, k, _ in segments] + [(-d, k) for d, k in chosen]
        want[i], line[i] = (*min(tops, default=(None, None)), len(tops)), len(segments)
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), templates).collect()}
    for i, text in rows:
        assert (None if got[i].dice is None else -got[i].dice, got[i].licence, got[i].n_found) == want[i], text
    assert sum(x[2] > 0 for x in want.values()) > 100 and sum(got[i].n_found > line[i] for i, _ in rows) > 50


def test_licence_sets_against_brute_force():
    a = licences.compiled({"a": "x y z x y", "b": "x y"})
    assert [(n, len(b)) for n, b in a] == [("a", 3), ("b", 1)]
    assert licences.best(a[0][1], a, 0.5) == (1.0, "a")


def test_languages(spark):
    letters = {"aa": "abcde", "bb": "fghij"}
    text = lambda k: " ".join("".join(RNG.choice(letters[k]) for _ in range(5)) for _ in range(30))
    rows = [(i, text(k), k) for i, k in enumerate(["aa", "bb"] * 60)] + [(500, None, "aa"), (501, "12 34", "bb"), (502, "", None), (None, text("aa"), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(d).collect()}
    assert all(out[i].lang_pred == k for i, _, k in rows[:120])
    assert [out[i].lang_pred for i in (500, 501, 502, None)] == ["und", "und", "und", "aa"]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out.values())
    assert langid.identify(d.limit(0)).count() == 0


def test_language_id_keeps_every_language(spark):
    name = lambda i: "".join(chr(97 + i // 26**j % 26) for j in range(3))
    d = spark.createDataFrame([(" ".join([name(i)] * 3), f"l{i}") for i in range(1100)], "text string, lang string").repartition(2)
    profiles = langid.learn(d)
    assert set(profiles) == {f"l{i}" for i in range(1100)}
    assert all(profiles[f"l{i}"] == langid.ranked(" ".join([name(i)] * 3)).tolist() for i in (0, 500, 1099))


def test_language_id_learns_from_copies_once(spark):
    own = [(f"{prose(30)} {i}", "en") for i in range(300)]
    once, often = (spark.createDataFrame(own + [("zq zq zqz qqz", "en")] * n, "text string, lang string").repartition(3) for n in (1, 150))
    for sample in (100, 1000):
        assert langid.learn(often, sample) == langid.learn(once, sample)


def test_language_id_distances_against_brute_force(spark):
    profiles = {x: langid.ranked(prose(200) + " " + x * 9).tolist() for x in "abcde"}
    rows = [(i, prose(30) + RNG.choice("abcde") * 5) for i in range(50)]
    size = max(map(len, profiles.values()))
    for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), profiles, "doc_id").collect():
        own = langid.ranked(rows[r.doc_id][1], size).tolist()
        fits = {x: 1 - sum(abs(p.index(c) - i) if c in p else size for i, c in enumerate(own)) / (size * len(own)) for x, p in profiles.items()}
        assert math.isclose(r.fit, max(fits.values())) and r.lang_pred == max(sorted(fits), key=fits.get)


def test_toxicity(spark):
    bad = lambda i: i % 3 == 0
    rows = [(i, " ".join([f"{RNG.choice('abcdefgh')}{RNG.randrange(50)}" for _ in range(40)] + (["vile", "rotten"] if bad(i) else ["kind"]))) for i in range(400)]
    d = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bad(i))) for i in range(400)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.classify(d, labels).collect()}
    held = [i for i in range(400) if out[i].held_out]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i].predicted == bad(i) for i in held]) > 0.95
    assert 0 <= out[1000].score <= 1 and out[1000].score == out[1001].score
    assert toxicity.classify(d.limit(0), labels).count() == 0 and toxicity.classify(d, labels.limit(0)).count() == len(rows) + 3


def test_kneser_ney_against_brute_force(spark):
    """Probabilities of both classes from plain dictionaries, and the evidence of unseen texts."""
    rng = random.Random(4)
    made = [(i, int(i % 4 == 0), " ".join(rng.choice("abcdefgh") + (rng.choice("xyz") if i % 4 == 0 and rng.random() < 0.4 else "") for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    d = spark.createDataFrame([(i, t, "clash") for i, _, t in made], "doc_id long, text string, toxic string")
    model = toxicity.learn(d, spark.createDataFrame([(i, y) for i, y, _ in made], "doc_id long, toxic int"))
    triples = {(y, *(["", "", *t.split()][j : j + 3])) for _, y, t in made for j in range(len(t.split()))}
    n = Counter((y, v, w) for y, _, v, w in triples)
    follow = {y: Counter(w for (c, v, w) in n if c == y) for y in (0, 1)}
    words = {x for _, v, w in n for x in (v, w)}
    shared = {w: max(1, sum(follow[y][w] > 0 for y in (0, 1))) for w in words}
    every = sum(shared.values()) + 1

    def lower(y, w):
        back = toxicity.DISCOUNT * len(follow[y])
        return (max(follow[y][w] - toxicity.DISCOUNT, 0) + back * shared.get(w, 1) / every) / sum(follow[y].values())

    def p(y, v, w):
        own = {x: c for (z, u, x), c in n.items() if z == y and u == v}
        if not own:
            return lower(y, w)
        kept = {x: max(c - toxicity.DISCOUNT, 0) for x, c in own.items() if n[0, v, x] + n[1, v, x] >= toxicity.LEAST}
        left = sum(own.values()) - sum(kept.values())
        return (kept.get(w, 0) + left * lower(y, w)) / sum(own.values())

    assert math.isclose(sum(lower(1, w) for w in [*words, "other"]), 1) and math.isclose(sum(p(0, "a", w) for w in [*words, "other"]), 1)
    fresh = ["a b cx dy", "zz a ax by cz ax", "h g f e d c b a", ""]
    found = toxicity.score(spark.createDataFrame(list(enumerate(fresh)), "doc_id long, text string"), model).collect()
    for r in found:
        w = fresh[r.doc_id].split()
        ratios = sorted((math.log(p(1, v, x) / p(0, v, x)) for v, x in zip([None, *w], w)), reverse=True) if w else []
        want = [sum(ratios) / max(len(w), 1), *[sum(ratios[:k]) / k for k in toxicity.TOP], math.log(1 + len(w))]
        assert np.allclose([r[name] for name in toxicity.FIGURES], want, atol=1e-5), (r, want)


def test_toxicity_sample_is_bounded(spark):
    d = spark.createDataFrame([(i, f"word{i} " * 50) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    chosen, shares, base = toxicity.sampled(d, labels, 100, 10_000)
    sizes = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert base == 0.5 and all(0 < n < 20_000 for n in sizes.values()) and all(0 < x < 0.5 for x in shares.values())


def test_cuts_take_whole_characters(spark):
    """A passage that starts and ends inside characters of another text; genuine replacement characters stay."""
    passage = "é\ufffdä日本語" + prose(20) + "日"
    raw = passage.encode()
    rows = [(1, "x" + passage + "y"), (2, "è\ufffdä日本語" + prose(0) + passage[6:-1] + "旦 tail \ufffd")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in suffixes.dedup(d, characters=True).collect()}
    assert bytes(found[1].kept).decode() == rows[0][1] and len(raw) > 60
    a, b = rows[1][1].encode(), rows[0][1].encode()
    gone = [False] * len(a)
    for j in range(len(a) - 49):
        if a[j : j + 50] in b:
            gone[j : j + 50] = [True] * 50
    at, want = 0, ""
    for c in rows[1][1]:
        n = len(c.encode())
        want += "" if any(gone[at : at + n]) else c
        at += n
    assert bytes(found[2].kept).decode() == want and "\ufffd" in want and found[2].n_removed == len(a) - len(want.encode())


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Documents with nulls, copies and repeated rows, toxic ones, and labels."""
    rng = random.Random(12)
    top = str(tmp_path_factory.mktemp("corpus"))
    rows = []
    for i in range(200):
        words = [rng.choice(WORDS[:8]) + str(rng.randrange(60)) for _ in range(rng.randrange(20, 60))]
        rows.append((i, " ".join(words + ["vile"] * (i % 6 == 0)), "en" if i % 3 else "xx", "web", 1))
    rows += [(300 + i, rows[i][1] + " end", "en", "web", 1) for i in range(20)] + [rows[4], rows[4], (500, None, "en", None, 0), (501, "", None, "web", 0), (502, "12 34 .", "en", "web", 7), (None, rows[3][1], "en", "web", 1), (5, "another text with this doc_id", "en", "web", 1)]
    rows += [(600, "Ωμέγα και άλφα " * 9, "el", "web", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(200)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def as_rows(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


def test_pipeline_stages(spark, folder):
    """Each stage's rows against its stated rule, on whole rows."""
    import corpus_pipeline as P

    given_ = spark.read.parquet(f"{folder}/documents.parquet")
    every = as_rows(given_)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    verdict = {r.doc_id: r.predicted for r in toxicity.classify(given_, labels).collect()}
    left = as_rows(P.toxicity_stage(spark, given_, folder))
    assert all(left[r] in (0, n) for r, n in every.items()) and sum(left.values()) < sum(every.values())
    assert not [r for r in every if r[0] != 5 and (left[r] > 0) != (verdict[r[0]] == 0)]
    assert not [r for r in left if "vile" in (r[1] or "")] and sum(left.values()) > 150
    left = as_rows(P.language_stage(spark, given_, folder))
    fits = {r.text: (r.lang_pred, r.fit) for r in langid.predict(given_.select("text"), langid.learn(given_.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")), "text").collect()}
    assert left == Counter({r: n for r, n in every.items() if fits[r[1]][0] != "und" and fits[r[1]][1] >= P.LEAST_FIT})
    assert not any(r[0] in (500, 501, 502) for r in left) and sum(left.values()) > 200
    sets = [(r, shingles(r[1])) for r in every]
    near_ = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    first = {r: min([r[0]] + [q[0] for q, b in sets if q[0] is not None and near_(a, b)]) if r[0] is not None else None for r, a in sets}
    left = as_rows(P.jaccard_stage(spark, given_, folder))
    ids = {r[0] for r in every if first[r] == r[0] and r[0] is not None}
    assert left == Counter({r: 1 if r[0] is not None else n for r, n in every.items() if r[0] in ids or r[0] is None})
    left = P.suffix_stage(spark, given_, folder)
    cut = {(r.doc_id, r.text) for r in left.collect()}
    exact = {(r.doc_id, bytes(r.kept).decode()) for r in suffixes.dedup(given_).collect()}  # these texts are ASCII, or lose nothing
    assert cut == exact and all(r.n_chars == len(r.text) for r in left.collect()) and left.count() == sum(every.values())
    pieces = P.packing_stage(spark, given_, folder).collect()
    assert sum(p.length for p in pieces) == sum(n * (len(vocabulary.encode(vocabulary.json_file(), r[1] or "")) + 1) for r, n in every.items())
    nothing = given_.limit(0)
    assert all(stage(spark, nothing, folder).count() == 0 for _, stage in P.STAGES)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and len(corpus_pipeline.STAGES) == 5
