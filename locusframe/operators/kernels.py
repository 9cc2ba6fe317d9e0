"""Numeric kernels as functions of arrays, and their forms on tables.

Pairs of texts and rows of likelihoods are solved in Arrow batches, many at
once; hidden Markov models along a series are solved by ranges: each range
gives a matrix of states x states for a series that may go on beyond it, these
are combined along the series, and each range then is solved between the states
at its borders, its series side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ordered import ranged

TINY = -1e300


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials along an axis."""
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def viterbi(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, last: int | None = None) -> np.ndarray:
    """Most probable states; all arguments are logarithms, emissions by time and state. last: the state to end in."""
    score, back = start + emissions[0], []
    for row in emissions[1:]:
        step = score[:, None] + transitions
        back.append(step.argmax(0))
        score = step.max(0) + row
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def forward_backward(emissions: np.ndarray, transitions: np.ndarray, start: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Posterior probability of each state at each time. after: logarithms of what follows the last time, by state."""
    f = [start + emissions[0]]
    for row in emissions[1:]:
        f.append(lse(f[-1][:, None] + transitions, 0) + row)
    b = [np.zeros(len(start)) if after is None else after]
    for row in emissions[:0:-1]:
        b.append(lse(transitions + row + b[-1], 1))
    joint = np.array(f) + np.array(b[::-1])
    return np.exp(joint - lse(joint, 1)[:, None])


def transfer(emissions: np.ndarray, transitions: np.ndarray, best: bool) -> np.ndarray:
    """From each state before the first time to each state at the last: the best path's score, or the sum over paths."""
    join = (lambda x: x.max(1)) if best else (lambda x: lse(x, 1))
    out = transitions + emissions[0]
    for row in emissions[1:]:
        out = join(out[:, :, None] + transitions[None]) + row
    return out


def swept(start: np.ndarray, emissions: np.ndarray, transitions: np.ndarray, best: bool) -> np.ndarray:
    """By state at the last time: the best path's score, or the sum over paths, from the start on."""
    out = start + emissions[0]
    for row in emissions[1:]:
        step = out[:, None] + transitions
        out = (step.max(0) if best else lse(step, 0)) + row
    return out


#: Times x series that are solved side by side.
SIDE_BY_SIDE = 1_000_000


def _side_by_side(begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Series in lots, the longest first: their numbers, the place of each one's row at each time (of shorter ones their last), and how many have a row at each time."""
    order = np.argsort(-sizes, kind="stable")
    done = 0
    while done < len(order):
        longest = int(sizes[order[done]])
        lot = order[done : done + max(1, SIDE_BY_SIDE // longest)]
        times = np.arange(longest)
        yield lot, begins[lot] + np.minimum(times[:, None], sizes[lot] - 1), np.searchsorted(-sizes[lot], -times, "left").tolist()
        done += len(lot)


def viterbi_of_series(emissions: np.ndarray, begins: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """viterbi() of many series that lie one after another, solved side by side. start: by series and state; last: states to end in, or -1."""
    out = np.zeros(len(emissions), np.int64)
    for lot, places, alive in _side_by_side(begins, sizes):
        own = emissions[places]
        score = start[lot] + own[0]
        back = np.zeros(own.shape, np.int16)
        for t in range(1, len(own)):
            n = alive[t]
            step = score[:n, :, None] + transitions
            back[t, :n] = step.argmax(1)
            score[:n] = step.max(1) + own[t, :n]
        state = np.where(last[lot] < 0, score.argmax(1), last[lot])
        for t in range(len(own) - 1, -1, -1):
            n = alive[t]
            out[places[t, :n]] = state[:n]
            state[:n] = back[t, np.arange(n), state[:n]]
    return out


def posteriors_of_series(emissions: np.ndarray, begins: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """forward_backward() of many series that lie one after another, solved side by side. start, after: by series and state."""
    out = np.zeros(emissions.shape)
    for lot, places, alive in _side_by_side(begins, sizes):
        own = emissions[places]
        f, b = np.zeros(own.shape), np.array(after[lot], float)
        f[0] = start[lot] + own[0]
        for t in range(1, len(own)):
            n = alive[t]
            f[t, :n] = lse(f[t - 1, :n, :, None] + transitions, 1) + own[t, :n]
        for t in range(len(own) - 1, -1, -1):
            n = alive[t]
            joint = f[t, :n] + b[:n]
            out[places[t, :n]] = np.exp(joint - lse(joint, 1)[:, None])
            b[:n] = lse(transitions + (own[t, :n] + b[:n])[:, None, :], 2)
    return out


def _gaussian(values: np.ndarray, means: np.ndarray, sd: float) -> np.ndarray:
    return -((values[:, None] - means) ** 2) / (2 * sd * sd)


def _hidden_states(df: DataFrame, group: str, at: str, value: str, means: list[float], sd: float, stay: float, best: bool, parts: int | None) -> DataFrame:
    k, centres = len(means), np.array(means)
    transitions = np.log(np.full((k, k), (1 - stay) / max(k - 1, 1)) + np.eye(k) * (stay - (1 - stay) / max(k - 1, 1)))
    start = np.full(k, -np.log(k))
    types = dict(df.dtypes)
    rows = ranged(df.select(group, at, value), [group], [at], parts)

    def laid_out(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """The rows in order, and where each series begins and how long it is."""
        frame = frame.sort_values([group, at], kind="stable", na_position="first", ignore_index=True)
        codes = pd.factorize(frame[group], use_na_sentinel=False)[0]
        begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        return frame, begins, np.diff(np.r_[begins, len(frame)])

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        """The first and the last series of a range: only they can go on in another one."""
        frame, begins, sizes = laid_out(frame)
        out = []
        for n in sorted({0, len(begins) - 1}):
            series = frame.iloc[begins[n] : begins[n] + sizes[n]]
            emissions = _gaussian(series[value].to_numpy(float), centres, sd)
            out.append((series[group].iloc[0], series["pid"].iloc[0], transfer(emissions, transitions, best).ravel().tolist(), swept(start, emissions, transitions, best).tolist()))
        return pd.DataFrame(out, columns=[group, "pid", "matrix", "first"])

    def borders(ranges: pd.DataFrame) -> pd.DataFrame:
        ranges = ranges.sort_values("pid")
        matrices = [np.array(m).reshape(k, k) for m in ranges["matrix"]]
        f = [np.array(ranges["first"].iloc[0])]
        for m in matrices[1:]:
            step = f[-1][:, None] + m
            f.append(step.max(0) if best else lse(step, 0))
        before = [np.full(k, TINY)] + f[:-1]
        if best:
            states = [int(f[-1].argmax())]
            for m, x in zip(matrices[:0:-1], f[-2::-1], strict=True):
                states.append(int((x + m[:, states[-1]]).argmax()))
            after = [[float(s)] for s in states[::-1]]
        else:
            b = [np.zeros(k)]
            for m in matrices[:0:-1]:
                b.append(lse(m + b[-1], 1))
            after = [x.tolist() for x in b[::-1]]
        return pd.DataFrame({group: ranges[group], "pid": ranges["pid"], "before": [x.tolist() for x in before], "is_first": [True] + [False] * (len(f) - 1), "after": after})

    def solve(frame: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        frame, begins, sizes = laid_out(frame)
        emissions = _gaussian(frame[value].to_numpy(float), centres, sd)
        begin, after = np.tile(start, (len(begins), 1)), np.full((len(begins), 1), -1.0) if best else np.zeros((len(begins), k))
        name = lambda x: None if pd.isna(x) else x
        known = {name(g): x for g, *x in zip(edges[group], edges["before"], edges["is_first"], edges["after"], strict=True)}
        for n in {0, len(begins) - 1}:
            before, is_first, follows = known[name(frame[group].iloc[begins[n]])]
            if not is_first:
                step = np.array(before)[:, None] + transitions
                begin[n] = step.max(0) if best else lse(step, 0)
            after[n] = follows
        if best:
            return frame[[group, at]].assign(state=viterbi_of_series(emissions, begins, sizes, transitions, begin, after[:, 0].astype(int)))
        return frame[[group, at]].assign(posterior=list(posteriors_of_series(emissions, begins, sizes, transitions, begin, after)))

    keys = f"{group} {types[group]}, pid int"
    matrices = rows.groupBy("pid").applyInPandas(summary, f"{keys}, matrix array<double>, first array<double>")
    edges = matrices.groupBy(group).applyInPandas(borders, f"{keys}, before array<double>, is_first boolean, after array<double>")  # two rows for each range
    result = "state long" if best else "posterior array<double>"
    return rows.groupBy("pid").cogroup(edges.groupBy("pid")).applyInPandas(solve, f"{group} {types[group]}, {at} {types[at]}, {result}")


def viterbi_segments(df: DataFrame, group: str, at: str, value: str, means: list[float], sd: float, stay: float, parts: int | None = None) -> DataFrame:
    """The most probable hidden state of each row of a series with Gaussian emissions. (group, at) must be unique."""
    return _hidden_states(df, group, at, value, means, sd, stay, True, parts)


def state_posteriors(df: DataFrame, group: str, at: str, value: str, means: list[float], sd: float, stay: float, parts: int | None = None) -> DataFrame:
    """The posterior probability of each hidden state of each row of such a series."""
    return _hidden_states(df, group, at, value, means, sd, stay, False, parts)


#: Scores of a match and a mismatch, of a gap's first and further bases.
MATCH, MISMATCH, OPEN, EXTEND = 25, -50, -110, -6


def smith_waterman(reference: str, other: str, match: int = MATCH, mismatch: int = MISMATCH, opening: int = OPEN, extend: int = EXTEND) -> tuple[int, int, str]:
    """(score, offset, CIGAR) of the best alignment of a text to a reference.

    Gaps have affine costs.  Either text may hang over the other's ends for
    free: bases of ``other`` beyond the reference are soft-clipped, and offset
    is where in the reference the alignment begins.  Ties prefer a match, then
    a deletion, and the end nearest the diagonal.
    """
    n, m = len(reference), len(other)
    if not n or not m:
        return 0, 0, f"{m}S" if m else ""
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (reference, other))
    low = -(1 << 40)
    best = np.zeros((n + 1, m + 1), np.int64)
    down, across = np.full((n + 1, m + 1), low), np.full((n + 1, m + 1), low)
    steps = np.arange(m + 1) * extend
    for i in range(1, n + 1):
        down[i, 1:] = np.maximum(best[i - 1, 1:] + opening, down[i - 1, 1:] + extend)
        fresh = np.zeros(m + 1, np.int64)
        fresh[1:] = np.maximum(best[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch), down[i, 1:])
        # a gap along the row costs by its length: the best place to open it is a running maximum
        reach = np.maximum.accumulate(fresh - steps)
        across[i, 1:] = reach[:-1] + steps[1:] - extend + opening
        best[i, 1:] = np.maximum(fresh[1:], across[i, 1:])
        best[i, 0] = 0
    ends = [(int(best[i, m]), -abs(i - m), i, m) for i in range(1, n + 1)] + [(int(best[n, j]), -abs(n - j), n, j) for j in range(1, m + 1)]
    score, _, i, j = max(ends)
    ops: list[list] = [["S", m - j]] if j < m else []

    def add(op: str, size: int = 1) -> None:
        if ops and ops[-1][0] == op:
            ops[-1][1] += size
        else:
            ops.append([op, size])

    while i and j:
        if best[i, j] == best[i - 1, j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
            add("M")
            i, j = i - 1, j - 1
        elif best[i, j] == down[i, j]:
            while True:
                add("D")
                i -= 1
                if down[i + 1, j] == best[i, j] + opening:
                    break
        else:
            size = 1
            while across[i, j] != best[i, j - size] + opening + (size - 1) * extend:
                size += 1
            add("I", size)
            j -= size
    if j:
        add("S", j)
    return score, i, "".join(f"{size}{op}" for op, size in reversed(ops))


#: Pairs that are aligned at once, and cells of their tables: they bound a worker's memory.
PAIRS, CELLS = 2000, 4_000_000


def smith_waterman_pairs(references: list[str], others: list[str], match: int = MATCH, mismatch: int = MISMATCH, opening: int = OPEN, extend: int = EXTEND) -> list[tuple[int, int, str]]:
    """What smith_waterman() gives for each pair; all pairs are solved at once, row by row of their tables and step by step of their ways back."""
    n, m = (np.array([len(t) for t in texts], np.int64) for texts in (references, others))
    found: list[tuple[int, int, str]] = [(0, 0, f"{k}S" if k else "") for k in m.tolist()]
    some = np.flatnonzero((n > 0) & (m > 0))
    if not len(some):
        return found
    n, m, b = n[some], m[some], len(some)
    height, width = int(n.max()), int(m.max())

    def padded(texts: list[str], size: int, fill: int) -> np.ndarray:
        out = np.full((b, size), fill, np.uint32)
        for row, k in zip(out, some, strict=True):
            row[: len(texts[k])] = np.frombuffer(texts[k].encode("utf-32-le"), np.uint32)
        return out

    x, y = padded(references, height, 0xFFFFFFFE), padded(others, width, 0xFFFFFFFF)
    low = -(1 << 40)
    shape = (height + 1, b, width + 1)
    best, down, across = np.zeros(shape, np.int64), np.full(shape, low), np.full(shape, low)
    steps = np.arange(width + 1) * extend
    for i in range(1, height + 1):
        np.maximum(best[i - 1, :, 1:] + opening, down[i - 1, :, 1:] + extend, out=down[i, :, 1:])
        fresh = np.zeros((b, width + 1), np.int64)
        np.maximum(best[i - 1, :, :-1] + np.where(y == x[:, i - 1 : i], match, mismatch), down[i, :, 1:], out=fresh[:, 1:])
        reach = np.maximum.accumulate(fresh - steps, axis=1)
        across[i, :, 1:] = reach[:, :-1] + (steps[1:] - extend + opening)
        np.maximum(fresh[:, 1:], across[i, :, 1:], out=best[i, :, 1:])
    every = np.arange(b)
    # ends lie in the last column or row of a pair; the best one, then the nearest to the diagonal, then the lowest, then the farthest right
    rows, columns = np.arange(1, height + 1)[:, None], np.arange(1, width + 1)[:, None]
    in_column, in_row = best[1:, every, m], best[n, every, 1:].T
    far = np.int64(height + width + 2)

    def rank(score: np.ndarray, i: np.ndarray, j: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.where(inside, ((score * far - np.abs(i - j)) * far + i) * far + j, np.iinfo(np.int64).min)

    last = np.concatenate([rank(in_column, rows, m, rows <= n), rank(in_row, n, columns, columns <= m)]).argmax(0)
    sideways = last >= height
    i, j = np.where(sideways, n, last + 1), np.where(sideways, last - height + 1, m)
    score = best[i, every, j]
    # ways back as (pair, operation, size); 0 M, 1 D, 2 I, 3 S
    whose, what, sizes = [every[j < m]], [np.full((j < m).sum(), 3)], [(m - j)[j < m]]

    def add(pairs: np.ndarray, op: int, size: np.ndarray | int) -> None:
        whose.append(pairs), what.append(np.full(len(pairs), op)), sizes.append(np.broadcast_to(size, len(pairs)))

    open_gap = np.zeros(b, bool)  # inside a deletion that has not been opened yet
    alive = every[(i > 0) & (j > 0)]
    while len(alive):
        a, c = i[alive], j[alive]
        here, gap = best[a, alive, c], open_gap[alive]
        same = np.where(x[alive, a - 1] == y[alive, c - 1], match, mismatch)
        straight = ~gap & (here == best[a - 1, alive, c - 1] + same)
        deleted = gap | (~straight & (here == down[a, alive, c]))
        moved = alive[straight]
        add(moved, 0, 1)
        gone = alive[deleted]
        add(gone, 1, 1)
        open_gap[gone] = down[i[gone], gone, j[gone]] != best[i[gone] - 1, gone, j[gone]] + opening
        inserted = alive[~straight & ~deleted]
        if len(inserted):
            size = np.zeros(len(inserted), np.int64)
            rest = np.arange(len(inserted))
            step = 0
            while len(rest):
                step += 1
                p = inserted[rest]
                hit = across[i[p], p, j[p]] == best[i[p], p, j[p] - step] + opening + (step - 1) * extend
                size[rest[hit]] = step
                rest = rest[~hit]
            add(inserted, 2, size)
            j[inserted] -= size
        i[moved] -= 1
        j[moved] -= 1
        i[gone] -= 1
        alive = alive[(i[alive] > 0) & (j[alive] > 0)]
    add(every[j > 0], 3, j[j > 0])
    pairs, ops, counts = np.concatenate(whose), np.concatenate(what), np.concatenate(sizes)
    order = np.argsort(pairs, kind="stable")[::-1]  # from the first base of a pair to its last
    pairs, ops, counts = pairs[order], ops[order], counts[order]
    heads = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (ops[1:] != ops[:-1])])
    totals, owners, letters = np.add.reduceat(counts, heads), pairs[heads].tolist(), ops[heads]
    texts = [f"{k}{'MDIS'[o]}" for k, o in zip(totals.tolist(), letters.tolist(), strict=True)]
    cigars = [""] * b
    for owner, text in zip(owners, texts, strict=True):
        cigars[owner] += text
    for k, s, at, cigar in zip(some.tolist(), score.tolist(), i.tolist(), cigars, strict=True):
        found[k] = (s, at, cigar)
    return found


def align(df: DataFrame, reference: str, other: str, key: str) -> DataFrame:
    """Score, offset and CIGAR of each row's text against its reference, in Arrow batches, many pairs at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = batch[reference].fillna("").tolist(), batch[other].fillna("").tolist()
            order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))  # pairs of one size share a table
            found: list = [None] * len(a)
            begin = 0
            while begin < len(order):
                end = begin + 1
                while end < len(order) and end - begin < PAIRS and (end - begin + 1) * (len(a[order[end]]) + 1) * (max(len(b[k]) for k in (order[begin], order[end])) + 1) <= CELLS:
                    end += 1
                own = order[begin:end]
                for k, x in zip(own, smith_waterman_pairs([a[k] for k in own], [b[k] for k in own]), strict=True):
                    found[k] = x
                begin = end
            yield pd.DataFrame({key: batch[key], "score": [x[0] for x in found], "offset": [x[1] for x in found], "cigar": [x[2] for x in found]})

    return df.select(key, reference, other).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, score long, offset long, cigar string")


#: What a likelihood starts with, so that long reads don't underflow.
SCALE = 2.0**1000


def pair_hmm(reads: list[str], quals: list, insertions: list, deletions: list, continuations: list, haplotypes: list[str]) -> np.ndarray:
    """log10 likelihoods of reads given haplotypes, pair by pair, with qualities for each base of a read and for gaps there.

    Three states (match, insertion, deletion); a read may begin and end anywhere
    in its haplotype; N matches all.  All pairs are solved along diagonals at once.
    """
    b = len(reads)
    n, h = np.array([len(r) for r in reads]), np.array([len(x) for x in haplotypes])
    most, width = int(n.max(initial=0)), int(h.max(initial=0))
    if not b or not most or not width:
        return np.where((n > 0) & (h > 0), 0.0, -np.inf) if b else np.zeros(0)

    def padded(rows: list, size: int, kind: type, fill: float) -> np.ndarray:
        out = np.full((b, size), fill, kind)
        for i, x in enumerate(rows):
            out[i, : len(x)] = x
        return out

    x = padded([np.frombuffer(r.encode(), np.uint8) for r in reads], most, np.uint8, 0)
    y = padded([np.frombuffer(r.encode(), np.uint8) for r in haplotypes], width, np.uint8, 1)
    error, opens_i, opens_d, goes_on = (10 ** (-padded(q, most, float, 40.0) / 10) for q in (quals, insertions, deletions, continuations))
    stays = 1 - (opens_i + opens_d)
    zeros = lambda: np.zeros((b, most + 1))
    m1, i1, d1, m2, i2, d2 = (zeros() for _ in range(6))  # the diagonal before, and the one before that
    begin = SCALE / np.maximum(h, 1)
    d1[:, 0] = begin  # place (0, 0)
    total, every = np.zeros(b), np.arange(1, most + 1)
    rows = np.arange(b)
    for diagonal in range(1, most + width + 1):
        j = diagonal - every  # place in the haplotype for each place in the read
        inside = (j >= 1) & (j[None] <= h[:, None]) & (every[None] <= n[:, None])
        base = y[:, np.clip(j - 1, 0, width - 1)]
        same = (base == x) | (x == 78) | (base == 78)
        emit = np.where(same, 1 - error, error / 3)
        m, i, d = zeros(), zeros(), zeros()
        m[:, 1:] = np.where(inside, emit * (stays * m2[:, :-1] + (1 - goes_on) * (i2[:, :-1] + d2[:, :-1])), 0)
        i[:, 1:] = np.where(inside, opens_i * m1[:, :-1] + goes_on * i1[:, :-1], 0)
        d[:, 1:] = np.where(inside, opens_d * m1[:, 1:] + goes_on * d1[:, 1:], 0)
        d[:, 0] = begin
        ends = diagonal - n
        total += np.where((ends >= 1) & (ends <= h), m[rows, n] + i[rows, n], 0)
        m2, i2, d2, m1, i1, d1 = m1, i1, d1, m, i, d
    with np.errstate(divide="ignore"):
        return np.log10(total) - np.log10(SCALE)


def likelihoods(df: DataFrame, key: list[str], read: str, quals: str, haplotype: str, gap: int = 45, continuation: int = 10, pairs: int = 256) -> DataFrame:
    """Each row's log10 likelihood; gap qualities are the same for all bases. Rows are solved ``pairs`` at a time, sorted by length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[(batch[read].str.len() > 0) & (batch[haplotype].str.len() > 0)]
            batch = batch.iloc[np.argsort(batch[read].str.len().to_numpy(), kind="stable")]
            for at in range(0, len(batch), pairs):
                own = batch.iloc[at : at + pairs]
                texts, haps = own[read].tolist(), own[haplotype].tolist()
                flat = lambda q: [np.full(len(t), q) for t in texts]  # noqa: E731, B023
                yield own[key].assign(log10=pair_hmm(texts, [np.asarray(q)[: len(t)] for q, t in zip(own[quals], texts, strict=True)], flat(gap), flat(gap), flat(continuation), haps))

    types = dict(df.dtypes)
    return df.select(*key, read, quals, haplotype).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in key) + ", log10 double")


def allele_count_posterior(likelihoods_: np.ndarray, log10_prior: np.ndarray) -> np.ndarray:
    """Probability of each count of alternate alleles among diploid samples. likelihoods_: log10, by sample and genotype; log10_prior: by count.

    Exact: samples are added one by one, each count's sum over all genotypes
    that make it up being kept.
    """
    g = 10.0 ** (likelihoods_ - likelihoods_.max(1, keepdims=True))
    z = np.array([1.0])
    for j, (g0, g1, g2) in enumerate(g, 1):
        k = np.arange(2 * j + 1)
        at = lambda i: np.where((k - i >= 0) & (k - i < len(z)), z[np.clip(k - i, 0, len(z) - 1)], 0)  # noqa: E731, B023
        z = ((2 * j - k) * (2 * j - k - 1) * at(0) * g0 + 2 * k * (2 * j - k) * at(1) * g1 + k * (k - 1) * at(2) * g2) / (2 * j * (2 * j - 1))
        z /= z.max()
    with np.errstate(divide="ignore"):
        log = np.log10(z) + log10_prior[: len(z)]
    p = 10.0 ** (log - log.max())
    return p / p.sum()


def allele_count_posteriors(likelihoods_: np.ndarray, log10_prior: np.ndarray) -> np.ndarray:
    """allele_count_posterior() of many sites with equally many samples. likelihoods_: log10, by site, sample and genotype."""
    g = 10.0 ** (likelihoods_ - likelihoods_.max(2, keepdims=True))
    z = np.ones((len(g), 1))
    for j in range(1, g.shape[1] + 1):
        k = np.arange(2 * j + 1)
        at = lambda i: np.pad(z, ((0, 0), (i, 2 - i)))  # noqa: E731, B023
        z = ((2 * j - k) * (2 * j - k - 1) * at(0) * g[:, j - 1, :1] + 2 * k * (2 * j - k) * at(1) * g[:, j - 1, 1:2] + k * (k - 1) * at(2) * g[:, j - 1, 2:]) / (2 * j * (2 * j - 1))
        z /= z.max(1, keepdims=True)
    with np.errstate(divide="ignore"):
        log = np.log10(z) + log10_prior[: z.shape[1]]
    p = 10.0 ** (log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


#: Genotype counts of sites that are solved at once.
SITE_CELLS = 1_000_000


def allele_counts(df: DataFrame, key: str, likelihoods_: str, theta: float = 1e-3) -> DataFrame:
    """key, ac (the most probable count of alternate alleles), qual (Phred of no alternate allele), from each row's genotype likelihoods (log10, an array for each sample).

    The prior of a count k > 0 is theta / k. Samples without likelihoods don't
    count. Sites with equally many samples are solved together.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites, ac, qual = batch.column(1), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            samples, own = sites.flatten(), pc.list_parent_indices(sites).to_numpy(zero_copy_only=False)
            good = pc.equal(pc.fill_null(pc.list_value_length(samples), 0), 3)
            x = samples.filter(good).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, 3)
            sizes = np.bincount(own[good.to_numpy(zero_copy_only=False)], minlength=batch.num_rows)
            begins = np.cumsum(sizes) - sizes
            for n in np.unique(sizes[sizes > 0]).tolist():
                prior = np.array([0.0] + [theta / k for k in range(1, 2 * n + 1)])
                prior[0] = max(1 - prior.sum(), 1e-300)
                rows = np.flatnonzero(sizes == n)
                for some in np.array_split(rows, max(1, len(rows) * (2 * n + 1) // SITE_CELLS)):
                    p = allele_count_posteriors(x[begins[some][:, None] + np.arange(n)], np.log10(prior))
                    ac[some], qual[some] = p.argmax(1), -10 * np.log10(np.maximum(p[:, 0], 1e-300))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ac), pa.array(qual)], names=[key, "ac", "qual"])

    return df.select(key, likelihoods_).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, ac long, qual double")


#: Distinct rows of features, with how often each occurs, that the driver fits itself; more are fitted by tasks.
FITTED_HERE = 100_000
#: As in Spark's GaussianMixture, whose steps these are: rows that a component starts from, least gain, most steps, what is added to a density.
SEEDS, GAIN, STEPS, EPSILON = 5, 0.01, 100, 2.0**-52


def _densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """By row and component; of singular covariances the pseudo-inverse."""
    out = np.empty((len(x), len(weights)))
    for c, (w, mean, cov) in enumerate(zip(weights, means, covs, strict=True)):
        values, vectors = np.linalg.eigh(cov)
        real = values > EPSILON * max(values.max(), 0.0) * len(values)
        if not real.any():
            raise ValueError("a component's rows are all the same")
        z = (x - mean) @ (vectors[:, real] / np.sqrt(values[real]))
        out[:, c] = EPSILON + w * np.exp(-0.5 * (len(mean) * np.log(2 * np.pi) + np.log(values[real]).sum()) - 0.5 * (z * z).sum(1))
    return out


def _expected(x: np.ndarray, n: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Sums of a step of expectation maximisation: the log-likelihood, then weights, means and squares by component, in one row."""
    p = _densities(x, weights, means, covs)
    total = p.sum(1)
    share = p / total[:, None] * n[:, None]
    return np.concatenate([[(np.log(total) * n).sum()], share.sum(0), (share.T @ x).ravel(), np.einsum("rc,ri,rj->cij", share, x, x, optimize=True).ravel()])


def _mixture(cells: DataFrame, features: list[str], seeds: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances fitted to rows of features that occur n times each. seeds: rows to start from, by component."""
    d = len(features)
    means = seeds.mean(1)
    covs = np.array([np.diag(x) for x in ((seeds - means[:, None]) ** 2).mean(1)])
    weights = np.full(components, 1 / components)
    here = None
    if len(first := cells.limit(FITTED_HERE + 1).toPandas()) <= FITTED_HERE:
        here = (first[features].to_numpy(float), first["n"].to_numpy(float))
    last, likelihood, step = -np.inf, 0.0, 0
    while step < STEPS and abs(likelihood - last) > GAIN:
        if here is not None:
            sums = _expected(*here, weights, means, covs)
        else:

            def part(batches: Iterator[pd.DataFrame], model: tuple = (weights, means, covs)) -> Iterator[pd.DataFrame]:
                own = sum((_expected(b[features].to_numpy(float), b["n"].to_numpy(float), *model) for b in batches if len(b)), np.zeros(1 + components * (1 + d + d * d)))
                yield pd.DataFrame({"sums": [own.tolist()]})

            sums = np.sum([r.sums for r in cells.mapInPandas(part, "sums array<double>").collect()], 0)  # a row for each task
        last, likelihood, step = likelihood, sums[0], step + 1
        own = sums[1 : 1 + components]
        means = sums[1 + components : 1 + components * (1 + d)].reshape(components, d) / own[:, None]
        covs = sums[1 + components * (1 + d) :].reshape(components, d, d) / own[:, None, None] - means[:, :, None] * means[:, None, :]
        weights = own / own.sum()
    return weights, means, covs


def mixture_scores(df: DataFrame, key: list[str], features: list[str], good: str, components: int = 2, seed: int = 7) -> DataFrame:
    """key and lod: the log10 density of a row under a Gaussian mixture of the rows where ``good`` holds, less that of the other rows. Fitted by expectation maximisation in the cluster."""
    import math

    known = df.filter(" and ".join(f"{f} is not null" for f in features))
    moments = known.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev(f).alias(f"s_{f}"))]).first()
    scaled = known.select(*key, good, *[((F.col(f) - F.lit(moments[f"m_{f}"])) / F.lit(moments[f"s_{f}"] or 1.0)).alias(f) for f in features])
    out = scaled.withColumn("x", F.array(*features))
    # equal rows are one with a number: a step of the fit costs by distinct rows
    of_side = F.coalesce(F.col(good), F.lit(False))
    cells = stored(scaled.groupBy(of_side.alias("side"), *features).agg(F.count("*").alias("n")), "cells")
    sides = []
    for side in (True, False):
        rows = scaled.filter(of_side == side).select(*[F.col(f).cast("double") for f in features])
        seeds = [[r.getDouble(i) for i in range(len(features))] for r in rows._jdf.rdd().takeSample(True, components * SEEDS, seed)]
        model = _mixture(cells.filter(F.col("side") == side), features, np.array(seeds).reshape(components, SEEDS, len(features)), components)
        terms = []
        for w, mean, own in zip(*model, strict=True):
            cov = own + 1e-6 * np.eye(len(features))
            inverse, size = np.linalg.inv(cov), math.log(max(w, 1e-300)) - 0.5 * (np.linalg.slogdet(cov)[1] + len(features) * math.log(2 * math.pi))
            d = [F.get("x", F.lit(i)) - float(mu) for i, mu in enumerate(mean)]
            square = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
            terms.append(F.lit(size) - square / 2)
        top = F.greatest(*terms) if len(terms) > 1 else terms[0]
        sides.append((top + F.log(sum((F.exp(t - top) for t in terms), F.lit(0.0)))) / math.log(10))
    return out.select(*key, (sides[0] - sides[1]).alias("lod"))
