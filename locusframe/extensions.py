"""Named extensions: what a user adds to the built-in filters, transforms, annotations, covariates, accumulators and region kernels.

An extension is a Python function that builds columns or transforms tables, so
it runs in the JVM like the built-in ones; region kernels and table functions
get Arrow or pandas batches.  Names are unique within a kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("filter", "transform", "annotation", "covariate", "accumulator", "rows", "kernel", "window")
_known: dict[str, dict[str, Callable[..., Any]]] = {kind: {} for kind in KINDS}


def register(kind: str, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """A decorator.

    filter, annotation, covariate: () -> Column.  transform: DataFrame ->
    DataFrame.  accumulator: () -> list of aggregate Columns, which Spark merges
    from partial results.  rows: () -> an array Column, one row for each of its
    elements.  kernel: a function of one region's pandas frame.  window: () ->
    (bases before, bases after).
    """
    if kind not in _known:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")

    def add(f: Callable[..., Any]) -> Callable[..., Any]:
        if name in _known[kind]:
            raise ValueError(f"there is a {kind} {name} already")
        _known[kind][name] = f
        return f

    return add


def forget(kind: str, name: str) -> None:
    _known[kind].pop(name, None)


def named(kind: str, name: str) -> Callable[..., Any]:
    if name not in _known[kind]:
        raise KeyError(f"no {kind} {name}; there are {', '.join(sorted(_known[kind])) or 'none'}")
    return _known[kind][name]


def _predicate(name: str) -> Column:
    """A registered or a built-in filter; ``not name`` negates it. Null drops the row."""
    from .operators.filters import PLAIN

    if name.startswith("not "):
        return ~_predicate(name[4:])
    return F.coalesce((_known["filter"].get(name) or PLAIN.get(name) or named("filter", name))(), F.lit(False))


def filtered(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows that all named filters keep."""
    for name in names:
        df = df.filter(_predicate(name))
    return df


def transformed(df: DataFrame, before: list[str] = (), filters: list[str] = (), after: list[str] = ()) -> DataFrame:
    """Transforms, then filters, then transforms."""
    for name in before:
        df = df.transform(named("transform", name))
    df = filtered(df, list(filters))
    for name in after:
        df = df.transform(named("transform", name))
    return df


def annotated(df: DataFrame, names: list[str]) -> DataFrame:
    """A column for each named annotation."""
    return df.withColumns({name: named("annotation", name)() for name in names})


def accumulated(df: DataFrame, covariates: list[str], accumulators: list[str]) -> DataFrame:
    """Named accumulators by named covariates (over all rows without covariates)."""
    keys = [named("covariate", c)().alias(c) for c in covariates]
    return df.groupBy(*keys).agg(*[x for a in accumulators for x in named("accumulator", a)()])


def exploded(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """Rows of a named table function, with some of the columns of the row that each comes from."""
    return df.select(*keep, F.explode(named("rows", name)()).alias(name))


def by_region(df: DataFrame, region: list[str], name: str, schema: str) -> DataFrame:
    """A named kernel over each region's rows, which one task holds: regions are of bounded length."""
    kernel = named("kernel", name)
    return df.groupBy(*region).applyInPandas(lambda rows: kernel(rows), schema)


def glued(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A function over each partition's batches, in their order."""
    return df.mapInPandas(f, schema)


def piped(df: DataFrame, command: list[str], column: str = "value") -> DataFrame:
    """Each partition's lines through a program's input and output (a process for each partition).

    What the program writes are the new rows; if it ends with an error, so does
    the task.  A thread feeds it, so that neither side waits for the other.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import subprocess
        import threading

        with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True) as process:

            def feed() -> None:
                with process.stdin:
                    for batch in batches:
                        process.stdin.writelines(f"{x}\n" for x in batch[column])

            feeder = threading.Thread(target=feed)
            feeder.start()
            held = []
            for line in process.stdout:
                held.append(line.rstrip("\n"))
                if len(held) >= 10_000:
                    yield pd.DataFrame({"value": held})
                    held = []
            feeder.join()
        if process.returncode:
            raise RuntimeError(f"{command[0]} ended with {process.returncode}")
        if held:
            yield pd.DataFrame({"value": held})

    return df.select(F.col(column).cast("string").alias(column)).mapInPandas(run, "value string")
