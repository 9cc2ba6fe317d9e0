"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has an interpolated Kneser-Ney bigram model over
words: the number of distinct words before a bigram, backed off to the number
of distinct words that a word follows in that class, backed off to counts that
both classes share: in how many of the two classes a word occurs at all.  (The
plain counts of a highest order are left out: copies of one passage would
swell them.)  A rare expression thus gets nearly the same probability from both
classes, while one that is frequent in one class only stands out.

The evidence of a text is the difference of the two log-likelihoods, divided by
the number of words, and the mean of the TOP words that add most to it (a long
text may hold few such words; the logarithm of its length allows for more words
meaning more chances).  A logistic curve over these turns them into a
probability.  It is fitted on the whole sample: the evidence of each of FOLDS
parts comes from models that haven't seen that part.

The sample is bounded in documents and bytes.  Its bigrams are counted and
summed up by word in tables; what comes to the driver is a row for each word,
and for each bigram that is seen LEAST times.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import LOWER, crc32_mod, groups, prepare, settle, texts, trimmed, word_hashes, written

#: About so many labelled documents of each class, at most, and so many bytes of them, are learned from.
SAMPLE, BYTES = 2800, 24 << 20
#: Parts of the sample, each of which is scored by models of the others to fit the curve.
FOLDS = 4
DISCOUNT = 0.75
TOP = (1, 3)
#: Bigrams seen less often in the sample are left to the backoff.
LEAST = 2
THRESHOLD = 0.3
FIGURES = ("mean", *(f"top{k}" for k in TOP), "log_n")
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Model(NamedTuple):
    vocabulary: np.ndarray  # sorted hashes; the index past the end is any other word
    bigrams: np.ndarray  # sorted keys: first * (len(vocabulary) + 1) + second
    joint: np.ndarray  # class x bigram: discounted counts
    total: np.ndarray  # class x word: counts of bigrams that it begins
    leave: np.ndarray  # class x word: discount mass it leaves to the backoff
    lower: np.ndarray  # class x word: probability by continuation
    curve: tuple[float, ...] = ()
    base: float = 0.0


def sums_by_word(counts: DataFrame, models: list[str]) -> tuple[DataFrame, DataFrame]:
    """For all models at once: a row for each word (sums over the bigrams that it begins or ends), and the bigrams that are frequent in some model.

    counts: first, second, and for each model and class c the column ``{model}{c}``.
    By word and class: counts of the bigrams that it begins, how many there are,
    how many it ends, and what rare ones leave to the backoff.
    """
    begins, ends, often = [], [], F.lit(False)
    for m in models:
        n = [F.col(f"{m}{c}") for c in (0, 1)]
        rare = n[0] + n[1] < LEAST
        often |= ~rare
        for c in (0, 1):
            begins += [F.sum(n[c]).cast("float").alias(f"{m}total{c}"), F.count_if(n[c] > 0).cast("float").alias(f"{m}kinds{c}"), F.sum(F.when(rare, F.greatest(n[c] - DISCOUNT, F.lit(0.0))).otherwise(0.0)).cast("float").alias(f"{m}rare{c}")]
            ends.append(F.count_if(n[c] > 0).cast("float").alias(f"{m}follow{c}"))
    words = counts.groupBy(F.col("first").alias("word")).agg(*begins).join(counts.groupBy(F.col("second").alias("word")).agg(*ends), "word", "full").fillna(0.0)
    return written(words, "words"), written(counts.filter(often), "often")


def model_of(by_word: DataFrame, often: DataFrame, which: str) -> Model:
    """One of the models of sums_by_word. Rows of its words and of its frequent bigrams are collected; the sample bounds both."""
    columns = {f"{x}{c}": F.col(f"{which}{x}{c}") for x in ("total", "kinds", "rare", "follow") for c in (0, 1)}
    known = sum((columns[f"{x}{c}"] for x in ("kinds", "follow") for c in (0, 1)), F.lit(0.0)) > 0
    words = by_word.filter(known).select("word", *[v.alias(k) for k, v in columns.items()]).toArrow()
    n = [F.col(f"{which}{c}") for c in (0, 1)]
    often = often.filter(n[0] + n[1] >= LEAST).select("first", "second", *[n[c].cast("float").alias(f"n{c}") for c in (0, 1)]).toArrow()
    vocabulary = words.column("word").to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, size = vocabulary[order], len(vocabulary)
    total, kinds, dropped, follow = (np.array([np.append(words.column(f"{x}{c}").to_numpy()[order], 0) for c in (0, 1)]) for x in ("total", "kinds", "rare", "follow"))
    shared = (follow > 0).sum(0).astype(float)
    shared[shared == 0] = 1
    shared /= shared.sum()
    lower = np.empty((2, size + 1))
    for c in (0, 1):
        mass = max(float(follow[c].sum(dtype=float)), 1.0)
        lower[c] = (np.maximum(follow[c] - DISCOUNT, 0) + max(DISCOUNT * (follow[c] > 0).sum(), 1e-9) * shared) / mass
    first, second = (np.searchsorted(vocabulary, often.column(x).to_numpy().view(np.uint64)) for x in ("first", "second"))
    keys = first * (size + 1) + second
    turn = np.argsort(keys)
    joint = np.array([np.maximum(often.column(f"n{c}").to_numpy()[turn] - DISCOUNT, 0) for c in (0, 1)], np.float32).reshape(2, -1)
    return Model(vocabulary, keys[turn], joint, total, DISCOUNT * kinds + dropped, lower)


def place(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, or the table's length."""
    at = np.searchsorted(table, x)
    at[at < len(table)] = np.where(table[at[at < len(table)]] == x[at < len(table)], at[at < len(table)], len(table))
    return at


def evidence(model: Model, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the mean log-likelihood ratio, the means of its TOP words with the greatest, and log(1 + words); 0 without words."""
    counts = np.diff(bounds)
    out = np.zeros((len(counts), 2 + len(TOP)))
    out[:, -1] = np.log1p(counts)
    if not len(words) or not len(model.vocabulary):
        return out
    size = len(model.vocabulary)
    w = place(model.vocabulary, words)
    p = model.lower[:, w]
    v = np.concatenate([[size], w[:-1]])
    v[bounds[:-1][counts > 0]] = size
    at = place(model.bigrams, v * (size + 1) + w) if len(model.bigrams) else np.zeros(len(w), np.int64)
    hit = at < len(model.bigrams)
    known = model.total[:, v] > 0
    seen = np.zeros(p.shape)
    seen[:, hit] = model.joint[:, at[hit]]
    p = np.where(known, (seen + model.leave[:, v] * p) / np.maximum(model.total[:, v], 1), p)
    ratio = np.log(p[1]) - np.log(p[0])
    most = max(TOP)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b > a:
            own = ratio[a:b]
            out[i, 0] = own.mean()
            best = np.sort(np.partition(own, -most)[-most:] if b - a > most else own)[::-1]
            for j, k in enumerate(TOP):
                out[i, 1 + j] = best[:k].sum() / k
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps with a weak ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        s = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, bounds = word_hashes(*texts(batch), NOT_WORD, LOWER)
    return hashes, bounds


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (class, part of the sample, word before, word, next word) of a block; a text's first word follows the word 0."""
    for block in groups(batches, 8 << 20):
        columns = []
        for batch in block:
            hashes, bounds = _words(batch)
            counts = np.diff(bounds)
            starts = bounds[:-1][counts > 0]
            one = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]])[: len(hashes)]
            one[starts] = 0
            two = np.concatenate([np.zeros(1, np.uint64), one[:-1]])[: len(hashes)]
            two[starts] = 0
            kind = batch.column("toxic").to_numpy(zero_copy_only=False) * FOLDS + batch.column("part").to_numpy(zero_copy_only=False)
            columns.append((np.repeat(kind.astype(np.uint64), counts), two, one, hashes))
        rows = np.stack([np.concatenate(x) for x in zip(*columns, strict=True)])
        rows = rows[:, np.lexsort(rows)]
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        rows = rows[:, new].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((rows[0] // FOLDS).astype(np.int32)), pa.array((1 << (rows[0] % FOLDS)).astype(np.int32)), *(pa.array(x) for x in rows[1:])], names=["toxic", "parts", "before", "first", "second"])


def sampled(docs: DataFrame, labels: DataFrame, sample: int, size: int) -> tuple[DataFrame, dict[int, float], float]:
    """Texts that are learned from (toxic, text, part), the share of each class that they are, and the share of toxic labels.

    Labelled documents are chosen by a hash of doc_id, and if these have more
    than ``size`` bytes in a class, fewer by a hash of the text; copies within a
    class count once.
    """
    labels = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shares = {c: min(1.0, sample / n) for c, n in sizes.items()}
    base = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    keep = F.lit(False)
    for c, share in shares.items():
        keep |= (F.col("toxic") == c) & (F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(1_000_003)) < share * 1_000_003)
    few = labels.filter(keep).groupBy("label_id").agg(F.max("toxic").alias("toxic"))  # bounded by the sample
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    at = F.xxhash64("text")
    chosen = rows.join(F.broadcast(few), F.col("doc_id") == F.col("label_id")).select("text", "toxic", at.alias("at"), F.pmod(F.shiftright(at, 24), F.lit(FOLDS)).cast("int").alias("part"))
    chosen = written(chosen.dropDuplicates(["toxic", "at"]), "labelled")  # copies count once
    thin = F.lit(True)
    for r in chosen.groupBy("toxic").agg(F.sum(F.length("text")).alias("size")).collect():
        if r.size and r.size > size:
            shares[r.toxic] *= size / r.size
            thin &= (F.col("toxic") != r.toxic) | (F.pmod(F.xxhash64("at", F.lit(13)), F.lit(1_000_003)) < size / r.size * 1_000_003)
    return chosen.filter(thin), shares, base


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = BYTES) -> Model:
    """docs: doc_id and text; labels: doc_id and toxic (0, 1; others and null don't count; of opposite labels of one doc_id 1 counts).

    What is learned from is bounded by about ``sample`` labels and ``size``
    bytes of each class; only these labels are joined to texts.
    """
    prepare(docs.sparkSession)
    chosen, shares, base = sampled(docs, labels, sample, size)
    triples = chosen.mapInArrow(trimmed(_triples), "toxic int, parts int, before long, first long, second long").groupBy("toxic", "before", "first", "second").agg(F.bit_or("parts").alias("parts"))
    elsewhere = lambda f: F.col("parts").bitwiseAND(F.lit((1 << FOLDS) - 1 - (1 << f))) != 0
    sums = [F.count_if((F.col("toxic") == c) & (elsewhere(f) if f < FOLDS else F.lit(True))).cast("int").alias(f"m{f}_{c}") for f in range(FOLDS + 1) for c in (0, 1)]
    counts = written(triples.groupBy("first", "second").agg(*sums), "bigrams")
    by_word, often = sums_by_word(counts, [f"m{f}_" for f in range(FOLDS + 1)])
    seen = []
    for f in range(FOLDS):
        part = chosen.filter(F.col("part") == f)
        seen.append(scored(part.select("toxic", "text"), model_of(by_word, often, f"m{f}_"), "toxic").toArrow())
    settle(docs.sparkSession)
    seen = pa.concat_tables(seen)
    model = model_of(by_word, often, f"m{FOLDS}_")
    y = seen.column("toxic").to_numpy().astype(float)
    x = np.column_stack([seen.column(name).to_numpy() for name in FIGURES])
    if len(set(y.tolist())) < 2:  # nothing to calibrate on: the share of toxic rows
        return model._replace(curve=(*[0.0] * len(FIGURES), float(np.log((base + 1e-6) / (1 - base + 1e-6)))), base=base)
    weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
    return model._replace(curve=tuple(logistic(x, y, weight * len(y) / weight.sum())), base=base)


def scored(rows: DataFrame, model: Model, *carried: str) -> DataFrame:
    """The carried columns, the number of words and the figures of evidence of each row's text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = _words(batch)
            x = evidence(shared.value, hashes, bounds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(np.diff(bounds)), *map(pa.array, x.T)], names=[*carried, "n", *FIGURES])

    schema = T.StructType([*(rows.schema[c] for c in carried), T.StructField("n", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in FIGURES)])
    return rows.mapInArrow(trimmed(run), schema)


def score(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """doc_id, score, the carried columns and the figures of evidence.

    A null or empty text, or one without words, has the sample's share of
    toxic documents as its score.  Texts of any length are scored as a whole;
    repeated rows each give a row; no rows give no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(c for c in carried if c != "text"))
    value = F.when(F.col("n") == 0, F.lit(model.base)).otherwise(1 / (1 + F.exp(-sum((F.lit(float(b)) * F.col(x) for x, b in zip(FIGURES, model.curve, strict=False)), F.lit(float(model.curve[-1])))))) if model.curve else F.lit(model.base)
    return scored(rows, model, "doc_id", *carried).select("doc_id", value.alias("score"), *carried, *FIGURES)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the figures of evidence for every row of docs (doc_id, text; more columns are ignored).

    labels: doc_id and toxic. Learned from labelled rows outside the held-out
    quarter by crc32 of doc_id; a null doc_id is in no fold: scored, never
    learned. Without labels every score is 0. Columns of docs or labels with
    other names, or those of the result, don't matter.
    """
    fold = crc32_mod("doc_id", 4)
    out = score(docs, learn(docs, labels.filter(fold != 2)))
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *FIGURES)
