"""Exact quantiles of a column of any size.

A mergeable sketch, one per partition, brackets the value of a wanted rank
within its stated error; what lies below the bracket is counted, and the search
goes on inside until few enough values are left to be counted one by one. Every
pass is one aggregation, and only brackets and the last few values reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a sketch of this accuracy misses a rank by at most 1/ACCURACY of its rows
ACCURACY = 10_000
#: rows in a bracket from which its values are counted singly
FEW = 50_000


def rank_of(n: int, permille: int) -> int:
    """The rank (from 1) of a quantile: ceil(n * permille / 1000), at least 1."""
    return max(1, -(-n * permille // 1000))


def exact_quantiles(df: DataFrame, col: str, permilles: list[int], accuracy: int = ACCURACY, few: int = FEW) -> list:
    """The values of ``col`` at the given thousandths, as they stand in the
    column: the smallest value with at least that share of the non-NULL values at
    or below it. All None for a column without values.

    ``df`` is read a few times: pass a stored table. Each pass of a bracket
    leaves about 4/``accuracy`` of its rows (and the ties of its ends), so two or
    three do for any table.
    """
    v, d = F.col(col), F.col(col).cast("double")
    values = df.select(col).where(v.isNotNull())
    n = values.count()
    if not n:
        return [None] * len(permilles)
    # per quantile: the rank inside the bracket, its ends (None: open) and rows
    state = [{"rank": rank_of(n, p), "ends": None, "rows": n} for p in permilles]

    def inside(s: dict) -> Column:
        return F.lit(True) if s["ends"] is None else (d >= F.lit(s["ends"][0])) & (d <= F.lit(s["ends"][1]))

    while True:
        wide = [s for s in state if s["rows"] > few and (s["ends"] is None or s["ends"][0] < s["ends"][1])]
        if not wide:
            break
        # the sketch misses a rank by 1/accuracy of the rows; twice that brackets it on either side
        marks = [[min(1.0, max(0.0, s["rank"] / s["rows"] + x / accuracy)) for x in (-2, 2)] for s in wide]
        found = values.agg(*[F.percentile_approx(F.when(inside(s), d), m, accuracy).alias(f"q{i}")
                             for i, (s, m) in enumerate(zip(wide, marks))]).first()
        narrowed = [{**s, "ends": (ends[0], ends[1])} for s, ends in zip(wide, found)]
        counts = values.agg(*[c for i, (s, m) in enumerate(zip(wide, narrowed)) for c in (
            F.count(F.when(inside(s) & (d < F.lit(m["ends"][0])), 1)).alias(f"below{i}"),
            F.count(F.when(inside(m), 1)).alias(f"rows{i}"))]).first()
        stuck = True
        for i, (s, m) in enumerate(zip(wide, narrowed)):
            below, rows = counts[f"below{i}"], counts[f"rows{i}"]
            if not below < s["rank"] <= below + rows:
                raise RuntimeError(f"rank {s['rank']} lies outside its bracket {m['ends']}")
            stuck = stuck and rows == s["rows"]
            s.update(rank=s["rank"] - below, ends=m["ends"], rows=rows)
        if stuck:  # a few values with many ties each
            break
    out = []
    for s in state:
        counted = values.where(inside(s)).groupBy(col).agg(F.count(F.lit(1)).alias("_n")).orderBy(col)
        left = s["rank"]
        for r in counted.toLocalIterator():  # at most ``few`` values, or the few that tie
            left -= r["_n"]
            if left <= 0:
                out.append(r[col])
                break
    return out
