"""Algorithms whose result depends on the order of rows: greedy matching and clustering, sequence ratios.

They are not transitive, so no component search replaces them. Rows are grouped
by a key that blocks them (a profile, a case), which bounds a group; the order
within is declared.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import ship


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def sequence_ratio(left, right):
    """Ratcliff and Obershelp's ratio of two text columns, in Arrow batches."""

    ship()

    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"pairs": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(left, right)


def greedy_clusters(rows: DataFrame, group: str, order: str, text: str, least: float) -> DataFrame:
    """(group, order, cluster): each row joins the first cluster whose representative is similar enough, or opens one; cluster is its representative's order."""

    ship(rows.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        heads: list[tuple[int, str]] = []
        out = []
        for at, body in zip(pdf[order], pdf[text], strict=True):
            found = next((h for h, t in heads if t == body or ratio(t, body) >= least), None)
            if found is None:
                heads.append((at, body))
                found = at
            out.append(found)
        return pd.DataFrame({group: pdf[group], order: pdf[order], "cluster": out})

    kinds = dict(rows.dtypes)
    return rows.select(group, order, text).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, cluster {kinds[order]}")


def greedy_matches(pairs: DataFrame, case: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """One-to-one pairs of a case: by falling score, each side is used once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[score] >= least].sort_values([score, left, right], ascending=[False, True, True])
        used_left, used_right, keep = set(), set(), []
        for k, (a, b) in enumerate(zip(pdf[left], pdf[right], strict=True)):
            if a not in used_left and b not in used_right:
                used_left.add(a)
                used_right.add(b)
                keep.append(k)
        return pdf.iloc[keep]

    return pairs.select(case, left, right, score).groupBy(case).applyInPandas(run, pairs.select(case, left, right, score).schema)
