"""Language identification by rank-order profiles of character n-grams.

A language's profile is its PROFILE most frequent character 1- to 3-grams, in
order.  A document's most frequent n-grams are compared to each profile: each
n-gram adds the difference of its two ranks, or PROFILE if the language's
profile lacks it (the out-of-place distance).  The nearest language wins.

Letters are folded to lower case and to 63 classes (a to z, and a hash of the
code point for others); a run of anything else counts as one gap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import crc32_mod, prepare, trimmed

PROFILE = 400
#: The model is learned from about this many labelled documents of each language (all, if there are fewer).
SAMPLE = 3000
ORDERS = (1, 2, 3)
CODES = 1 << 19
#: Languages that a task counts at once, at CODES numbers each, before it sends what it has.
HELD = 50


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point below 65,536: 0 for a gap."""
    out = np.zeros(1 << 16, np.int32)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()[0]
            out[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % (1 << 32) * 37 // (1 << 32)
    return out


def grams(text: str) -> np.ndarray:
    """Codes of a text's n-grams, none of which spans a gap. Empty if the text has no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = classes()[np.minimum(points, 0xFFFF)]
    wide = points > 0xFFFF
    if wide.any():
        symbols[wide] = [27 + (p * 2654435761 % (1 << 32)) * 37 // (1 << 32) if chr(p).isalpha() else 0 for p in points[wide].tolist()]
    if not symbols.any():
        return np.zeros(0, np.int32)
    symbols = np.concatenate([[0], symbols, [0]]).astype(np.int32)
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
    s = symbols[keep]
    one = s[s > 0]
    two = s[:-1] * 64 + s[1:]
    three = two[:-1] * 64 + s[2:]
    inner = s[1:-1] > 0
    return np.concatenate([one, 64 + two[(s[:-1] > 0) | (s[1:] > 0)], 64 + 4096 + three[inner]])


def most_frequent(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent, ties by code."""
    return codes[np.lexsort((codes, -counts))[:k]]


def ranked(text: str, k: int = PROFILE) -> np.ndarray:
    found = grams(text)
    if not len(found):
        return found
    return most_frequent(*np.unique(found, return_counts=True), k)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            found = grams(text.as_py())
            counts = total.setdefault(lang.as_py(), np.zeros(CODES, np.int64))
            counts += np.bincount(found, minlength=CODES)
            if len(total) >= HELD:
                yield from _counted(total)
                total.clear()
    yield from _counted(total)


def _counted(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in total.items():
        codes = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes, pa.int32()), pa.array(counts[codes])], names=["lang", "code", "n"])


def learn(docs: DataFrame, sample: int = SAMPLE, profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, from rows with text and lang; ``sample`` bounds (in expectation) the documents of each language.

    Rows are chosen by a hash of their text, and copies within a language
    count once. What comes to the driver is ``profile`` codes for each language.
    """
    prepare(docs.sparkSession)
    rows = docs.filter("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"), F.xxhash64("text").alias("hash"))
    shares = rows.select("lang", "hash").distinct().groupBy("lang").agg((F.lit(sample * 1e6) / F.count("*")).alias("share"))
    chosen = rows.join(F.broadcast(shares), "lang").filter(F.abs(F.col("hash") % 1_000_000) < F.col("share"))  # a row for each language
    chosen = chosen.dropDuplicates(["lang", "hash"]).select("text", "lang")
    counts = chosen.mapInArrow(trimmed(_count), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counts.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))), 1, profile).alias("best"))  # at most CODES entries for a language
    return {r.lang: [x.code for x in r.best] for r in best.collect()}


def predict(rows: DataFrame, profiles: dict[str, list[int]], *carried: str) -> DataFrame:
    """The carried columns, lang_pred, score and fit of each row's text.

    fit: 1 - distance / greatest distance of the best profile.  score: the
    best fit's share of the sum of the two best; with one language, the fit.  A null text, one without letters, or a model without languages
    gives ``und`` and 0.  Ties go to the first language by name.
    """
    names = sorted(profiles)
    size = max([len(p) for p in profiles.values()], default=0)
    model = rows.sparkSession.sparkContext.broadcast([profiles[name] for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by code, the languages whose profile has it and its rank there
        codes = np.concatenate([np.array(p, np.int64) for p in model.value]) if names else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        speaks = np.repeat(np.arange(len(names)), [len(p) for p in model.value])[order]
        ranks = np.concatenate([np.arange(len(p)) for p in model.value])[order] if names else codes
        starts = np.searchsorted(codes[order], np.arange(CODES + 1))
        for batch in batches:
            lang, score, fit = [], [], []
            for text in batch.column("text"):
                own = ranked(text.as_py() or "", size) if names else ()
                if not len(own):
                    lang.append("und"), score.append(0.0), fit.append(0.0)
                    continue
                n = starts[own + 1] - starts[own]
                at = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                saved = size - np.abs(ranks[at] - np.repeat(np.arange(len(own)), n))
                near = 1 - (size * len(own) - np.bincount(speaks[at], saved, len(names))) / (size * len(own))
                best = int(near.argmax())
                others = np.delete(near, best)
                top = float(near[best])
                lang.append(names[best]), fit.append(top)
                score.append(float(top / (top + others.max())) if len(others) and top > 0 else top)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())], names=[*carried, "lang_pred", "score", "fit"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())]
    return rows.mapInArrow(trimmed(run), T.StructType([*(rows.schema[c] for c in carried), *added]))


def identify(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and fit for every row of docs (doc_id, text, lang; more columns are ignored).

    Learned from rows outside the held-out fifth, by crc32 of doc_id, that
    have text and lang. A null doc_id is in no fold: not held out, not learned.
    """
    fold = crc32_mod("doc_id", 5)
    known = (training if training is not None else docs).filter(fold != 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    out = predict(rows, learn(known), "doc_id")
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "fit")
