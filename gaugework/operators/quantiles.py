"""Exact interpolated quantiles that no single task has to hold.

Each wanted rank is enclosed by a bracket.  A round counts what lies below and at the ends of the brackets of all columns,
and takes the values inside: all of them if they are few enough to be sorted, else a random sample of bounded size.
The sample only suggests the next, narrower bracket; ranks are counted, so the result is exact.  The first round only samples
whole columns.  A second one ends the search for a few million rows, and each further one for about a hundred times as many.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.operators.summary import long_form
from gaugework.session import chunks

BRACKET_ROWS = 100_000
SAMPLE_ROWS = 20_000
#: How many standard deviations a rank in the sample may be off before a bracket misses; a miss costs a scan.
MARGIN = 4.5
COLUMNS = 100  # of a scan: Spark aggregates lists by hash for up to 128 keys in a task
INFINITY = math.inf


@dataclass(frozen=True)
class _Bracket:
    """Open interval with about ``inside`` values, laid around ``ranks`` (0-based, over the whole column); what is certain
    is that they lie strictly between ``low`` and ``high``, with ``below`` values up to ``low`` and ``above`` from ``high`` on."""

    ranks: tuple[int, ...]
    start: float
    end: float
    inside: int
    below: int
    above: int
    low: float = -INFINITY
    high: float = INFINITY


def exact_quantiles(
    df: DataFrame,
    numbers: dict[str, Column],
    probabilities: tuple[float, ...],
    counts: dict[str, int] | None = None,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """Per name the quantiles of its finite numbers, linearly interpolated.

    ``numbers`` gives a double expression per name, NULL where there is none;
    ``counts`` its number of non-null values when already known.
    """
    result: dict[str, list[float | None]] = {}
    for names in chunks(list(numbers), COLUMNS):
        result |= _quantiles(df, {n: numbers[n] for n in names}, probabilities, counts, bracket_rows)
    return result


def _quantiles(df, numbers, probabilities, counts, bracket_rows) -> dict[str, list[float | None]]:
    names = list(numbers)
    cells = long_form(df, {str(i): numbers[n] for i, n in enumerate(names)})
    cells = cells.filter(F.col("value").isNotNull()).select(F.col("column").cast("int").alias("column"), "value")
    if counts is None:
        found = {r["column"]: r["count"] for r in cells.groupBy("column").count().collect()}
        counts = {n: found.get(i, 0) for i, n in enumerate(names)}
    position = {(n, p): p * (counts[n] - 1) for n in names if counts.get(n) for p in probabilities}
    values: dict[str, dict[int, float]] = {n: {} for n in names}
    brackets = {n: [] for n in names}
    for (n, _), at in position.items():
        ranks = tuple(sorted({math.floor(at), math.ceil(at)}))
        brackets[n].append(_Bracket(ranks, -INFINITY, INFINITY, counts[n], 0, counts[n]))
    while any(brackets.values()):
        looks = _look(cells, [list(dict.fromkeys(brackets[n])) for n in names], bracket_rows)
        for i, n in enumerate(names):
            old, brackets[n] = list(dict.fromkeys(brackets[n])), []
            for bracket, look in zip(old, looks[i]):
                brackets[n] += _next(bracket, look, counts[n], values[n], bracket_rows)
    result: dict[str, list[float | None]] = {n: [None] * len(probabilities) for n in names if not counts.get(n)}
    for (n, _), at in position.items():
        low, high = values[n][math.floor(at)], values[n][math.ceil(at)]
        result.setdefault(n, []).append(low + (high - low) * (at - math.floor(at)))
    return result


def _share(bracket: _Bracket, bracket_rows: int) -> float:
    """Share of the values inside that a scan takes."""
    return 1.0 if bracket.inside <= bracket_rows else min(1.0, SAMPLE_ROWS / bracket.inside)


def _look(cells: DataFrame, brackets: list[list[_Bracket]], bracket_rows: int) -> list[list[dict]]:
    """For each bracket: values below its start, at it, inside and at its end, and two of the values taken inside, where the
    first and the last rank are, or in a sample the ends of the next bracket.

    What is known of a column stands in literal arrays that are read by its number.
    """
    most = max(map(len, brackets))
    needed = cells.where(F.col("column").isin([i for i, b in enumerate(brackets) if b])).withColumn("draw", F.rand(1))

    def known(w: int, of, kind: str) -> Column:
        own = [of(b[w]) if w < len(b) else None for b in brackets]
        return F.get(F.array(*[F.lit(x).cast(kind) for x in own]), F.col("column"))

    def share(w: int) -> Column:
        return known(w, lambda b: _share(b, bracket_rows), "double")

    value, metrics = F.col("value"), []
    if all(b.start == -INFINITY and b.end == INFINITY for own in brackets for b in own):
        # whole columns: nothing is to be counted, so only the values taken go further
        needed = needed.where(F.col("draw") < share(0))
        everything = F.sort_array(F.collect_list(value)).alias("taken")
        counted = needed.groupBy("column").agg(everything)
        for w in range(most):
            none = {f"{c}{w}": F.lit(0).cast("bigint") for c in ("less", "at", "last")}
            counted = counted.withColumns(none | {f"inside{w}": known(w, lambda b: b.inside, "bigint"), f"taken{w}": F.col("taken")})
    else:
        # counts run in generated code, lists do not: only the few values inside come to them
        kept, lists = F.lit(False), []
        for w in range(most):
            start, end = known(w, lambda b: b.start, "double"), known(w, lambda b: b.end, "double")
            inside = (value > start) & (value < end)
            taken = inside & (F.col("draw") < share(w))
            kept = kept | taken
            metrics += [
                F.count_if(value < start).alias(f"less{w}"), F.count_if(value == start).alias(f"at{w}"),
                F.count_if(inside).alias(f"inside{w}"), F.count_if(value == end).alias(f"last{w}"),
            ]
            lists.append(F.sort_array(F.collect_list(F.when(taken, value))).alias(f"taken{w}"))
        counted = needed.groupBy("column").agg(*metrics)
        counted = counted.join(needed.where(kept).groupBy("column").agg(*lists), "column", "left")
    picked = [F.col("column")]
    for w in range(most):
        taken, inside = F.coalesce(f"taken{w}", F.array().cast("array<double>")), F.col(f"inside{w}")
        upto, size = F.col(f"less{w}") + F.col(f"at{w}"), F.size(taken)
        first, last = (known(w, lambda b, i=i: b.ranks[i], "bigint") - upto for i in (0, -1))
        reach = MARGIN * F.sqrt(size) / 2 + 2
        ends = (F.floor(first * size / inside - reach), F.ceil(last * size / inside + reach))
        whole = size == inside
        at = [F.when(whole, exact).otherwise(end).cast("int") for exact, end in zip((first, last), ends)]
        picked += [*(F.col(f"{c}{w}") for c in ("less", "at", "inside", "last")), whole.alias(f"whole{w}")]
        picked += [F.when(inside > 0, F.get(taken, x)).alias(f"pick{i}{w}") for i, x in enumerate(at)]
    looks: list[list[dict]] = [[] for _ in brackets]
    for r in counted.select(*picked).collect():
        names = ("less", "at", "inside", "last", "whole", "pick0", "pick1")
        looks[r["column"]] = [{c: r[f"{c}{w}"] for c in names} for w in range(len(brackets[r["column"]]))]
    for i, own in enumerate(brackets):  # a sample without a single value settles nothing
        nothing = {"less": 0, "at": 0, "last": 0, "whole": False, "pick0": None, "pick1": None}
        looks[i] = looks[i] or [nothing | {"inside": b.inside} for b in own]
    return looks


def _next(bracket: _Bracket, look: dict, count: int, values: dict[int, float], bracket_rows: int) -> list[_Bracket]:
    """Brackets for the ranks that one scan did not settle; the others' values are added."""
    upto = look["less"] + look["at"]
    under_end = upto + look["inside"]
    open_ranks: dict[_Bracket, list[int]] = {}
    for rank in bracket.ranks:
        if rank < look["less"]:  # missed: between what is certain and the start
            new = replace(bracket, ranks=(), start=bracket.low, end=bracket.start, high=bracket.start,
                          inside=look["less"] - bracket.below, above=look["less"])
        elif rank < upto:
            values[rank] = bracket.start
            continue
        elif rank < under_end:
            if look["whole"]:
                values[rank] = look["pick0"] if rank == bracket.ranks[0] else look["pick1"]
                continue
            sure = replace(bracket, low=bracket.start, high=bracket.end, below=upto, above=under_end)
            if look["inside"] <= bracket_rows:  # few after all: the same bracket, taken whole
                new = replace(sure, ranks=(), inside=look["inside"])
            else:
                start = bracket.start if look["pick0"] is None else look["pick0"]
                end = bracket.end if look["pick1"] is None else look["pick1"]
                held = math.ceil(look["inside"] * (MARGIN + 1) / math.sqrt(SAMPLE_ROWS))
                new = replace(sure, ranks=(), start=start, end=end, inside=held)
        elif rank < under_end + look["last"]:
            values[rank] = bracket.end
            continue
        else:  # missed: between the end and what is certain
            new = replace(bracket, ranks=(), start=bracket.end, end=bracket.high, low=bracket.end,
                          inside=bracket.above - under_end - look["last"], below=under_end + look["last"])
        open_ranks.setdefault(new, []).append(rank)
    return [replace(b, ranks=tuple(ranks)) for b, ranks in open_ranks.items()]
