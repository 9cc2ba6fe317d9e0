"""Quality rules with risk-controlled cutoffs, in DataFrame and SQL functions only.

Fixed base checks reject texts that are short or repeat themselves.  Each rule
then rejects a text whose value exceeds the rule's cutoff.  The cutoffs of all
rules are tightened in fixed steps, from lenient to strict, a level of each
rule after the other; how many steps are taken is decided for each stratum (a
text's language) on its labelled good texts that pass the base checks.  A step
is certified if, were the share of good texts that all cutoffs so far reject
together as high as RISK, so few rejections would have a probability (exact
binomial) of at most DELTA divided by the number of strata (Bonferroni).  The
first step that fails ends the stratum's sequence (fixed-sequence testing), so
the steps need no further correction.  With probability 1 - DELTA, no stratum
loses more than RISK of its good texts to the rules.  Copies of a labelled text
are one trial; near copies count as if they were independent.  A stratum needs
some 60 to 100 labelled good texts (with RISK and DELTA of 0.05 and up to ten
strata); with fewer it gets no cutoff, and its texts are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import written

RISK, DELTA = 0.05, 0.05
SPACES = " \t\n\x0b\f\r"
#: Value of each rule (whole numbers, per cent or per 100) and its cutoffs, lenient first.
RULES = {
    "symbols": ("100 * n_symbols div n_words", (400, 200, 100, 75, 50, 30, 20, 10)),
    "repeats": ("100 * n_repeat_words div n_words", (45, 40, 35, 30, 25, 20, 15, 10)),
    "lines": ("100 * n_dup_lines div greatest(n_lines, 1)", (75, 60, 50, 40, 30, 20)),
    "long": ("100 * word_chars div n_words", (3000, 2000, 1500, 1200, 1000, 900)),
    "short": ("-100 * word_chars div n_words", (-150, -200, -250, -300, -350)),
    "marks": ("100 * n_marks div n_words", (400, 200, 150, 100, 75, 50, 40, 30, 20)),
}


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, though f uses it for each element of an array."""
    return F.transform(F.array(x), f)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three that is found twice or more.

    Hashes of the windows are sorted with their positions, so equal windows
    become neighbours; no step is quadratic in the text.
    """
    n = F.size(words)
    hashes = bound(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        again = lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        places = bound(ordered, lambda s: F.array_sort(F.transform(again(s), lambda x: x["at"])))
        return bound(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x))

    return F.when(n < 4, F.lit(0)).otherwise(bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and counts of each text; a null text has no words, a null language is the stratum ``none``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(F.col("body"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("body"), "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("stratum"), text.alias("body")).select("doc_id", "stratum", "body", words.alias("words"), lines.alias("lines"))
    long = lambda x, name: x.cast("long").alias(name)
    return rows.select(
        "doc_id",
        "stratum",
        long(F.size("words"), "n_words"),
        long(F.length(F.array_join("words", "")), "word_chars"),
        long(F.regexp_count("body", F.lit(r"[#*$%&|<>]")), "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(repeated_words(F.col("words")), "n_repeat_words"),
        long(F.size("lines"), "n_lines"),
        long(F.regexp_count("body", F.lit("[!?]")), "n_marks"),
        F.xxhash64("body").alias("hash"),
    ).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def binomial(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial count, summed term by term in logarithms."""
    first = F.struct((n * F.log1p(F.lit(-p))).alias("t"), F.exp(n * F.log1p(F.lit(-p))).alias("s"))

    def add(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), first, add)["s"]


#: Steps in order: rule and cutoff.
STEPS = [(rule, grid[level]) for level in range(max(len(g) for _, g in RULES.values())) for rule, (_, grid) in RULES.items() if level < len(grid)]


def first_step() -> str:
    """The first step whose cutoff a text exceeds, as SQL; their number if it exceeds none. Needs a word."""
    cases = []
    for rule, (value, _) in RULES.items():
        cases.append("case " + " ".join(f"when {value} > {c} then {i}" for i, (r, c) in enumerate(STEPS) if r == rule) + f" else {len(STEPS)} end")
    return f"least({', '.join(cases)})"


def certified(rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, steps (how many are taken), n (labelled good texts). rows: of features(), with step.

    What is counted is a number for each stratum and step.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct()
    held = rows.filter("not base_failed").join(good, "doc_id").groupBy("stratum", "hash").agg(F.min("step").alias("step"))
    tallies = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("step") <= i).alias(f"k{i}") for i in range(len(STEPS))])
    strata = rows.select("stratum").distinct().agg(F.count("*").alias("strata"))  # one row
    tests = tallies.crossJoin(F.broadcast(strata)).select("stratum", "n", "strata", F.posexplode(F.array(*[f"k{i}" for i in range(len(STEPS))])).alias("i", "k"))
    p = F.when(F.col("k") < F.col("n") * risk, binomial(F.col("k"), F.col("n"), risk)).otherwise(1.0)
    return tests.withColumn("failed", p > F.lit(delta) / F.col("strata")).groupBy("stratum").agg(F.coalesce(F.min(F.when(F.col("failed"), F.col("i"))), F.lit(len(STEPS))).alias("steps"), F.first("n").alias("n"))


def cutoffs(steps: DataFrame) -> DataFrame:
    """A row for each stratum with the cutoff of each rule after its steps; null: the rule isn't used there."""
    last = lambda rule: F.coalesce(*[F.when(F.col("steps") > i, F.lit(c)) for i, (r, c) in reversed(list(enumerate(STEPS))) if r == rule])
    return steps.select("stratum", "n", *[last(rule).alias(rule) for rule in RULES])


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, base_failed and kept for every row of docs.

    docs: doc_id, text, lang; labels: doc_id, quality (1: good); more columns
    are ignored.  A null text has no words and fails the base checks, as does
    an empty one; a null language is a stratum.  A null doc_id has no label and
    is judged like others; repeated rows each give a row; of repeated or
    opposite labels of one doc_id a good one counts.  Texts of any length are
    judged as a whole.  No rows give no rows; without labels only the base
    checks reject.
    """
    rows = features(docs.select("doc_id", "text", "lang")).withColumn("step", F.when(~F.col("base_failed"), F.expr(first_step())))
    rows = written(rows, "features")
    # written, so that its size is known: a row for each stratum, which is broadcast unless there are very many
    steps = written(certified(rows, labels, risk, delta).select("stratum", "steps"), "steps")
    out = rows.join(steps, "stratum", "left")
    rejected = F.coalesce(F.col("step") < F.col("steps"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), "n_lines", "n_marks")


_STEPS_SQL = ", ".join(f"({i}, '{rule}', {c})" for i, (rule, c) in enumerate(STEPS))
_VALUE_SQL = "case rule " + " ".join(f"when '{rule}' then {value.replace(' div ', ' // ')}" for rule, (value, _) in RULES.items()) + " end"
SQL = f"""
with d as (select row_number() over () rid, doc_id, coalesce(lang, 'none') stratum, coalesce(text, '') body from documents),
w as (select rid, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
g as (select rid, unnest(range(1, len(ws) - 1)) i, ws from w where len(ws) >= 3),
h as (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) c from g),
r as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from h where c > 1) group by rid),
f as (select d.rid, d.doc_id, d.stratum, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
  len(regexp_extract_all(body, '[#*$%&|<>]'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words,
  len(ls)::bigint n_lines, len(regexp_extract_all(body, '[!?]'))::bigint n_marks, (len(ws) < 50 or 100 * coalesce(r.n, 0) > 50 * len(ws)) base_failed
  from d join w using (rid) left join r using (rid)),
chain(i, rule, cutoff) as (values {_STEPS_SQL}),
hit as (select f.doc_id, f.rid, stratum, min(i) i from f, chain where not base_failed and {_VALUE_SQL} > cutoff group by all),
held as (select f.stratum, d.body, min(coalesce(hit.i, {len(STEPS)})) i from f join d using (rid) left join hit on hit.rid = f.rid where not base_failed and f.doc_id in (select doc_id from labels where quality = 1) group by all),
tallies as (select stratum, c.i, count(*) n, count(*) filter (held.i <= c.i) k from held, chain c group by all),
tests as (select *, case when k < n * {RISK} then (select sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({RISK}) + (n - x) * ln({1 - RISK}))) from range(0, k + 1) t(x)) else 1 end p from tallies),
stops as (select stratum, coalesce(min(i) filter (p > {DELTA} / (select count(distinct stratum) from f)), {len(STEPS)}) steps from tests group by all)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_marks,
  not base_failed and coalesce(hit.i >= steps, true) kept from f left join hit on hit.rid = f.rid left join stops on stops.stratum = f.stratum
"""
