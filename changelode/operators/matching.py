"""Greedy one-to-one matching of cases and controls inside cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of categories and size bands.
CATEGORY_RANK = {"HIGH": 2, "MEDIUM": 1}
BAND_ORDER = ["0", "1-10", "11-50", "51-200", "201-1000"]
CELL = ("category", "subsystem", "size_band")


def category_rank(c: Column) -> Column:
    return F.when(F.upper(c) == "HIGH", 2).when(F.upper(c) == "MEDIUM", 1).otherwise(0)


def band_rank(c: Column) -> Column:
    out = F
    for i, band in enumerate(BAND_ORDER):
        out = out.when(c == band, i)
    return out.when(c == "1001+", 5).otherwise(6)


def cell_key(keys: Sequence[str]) -> Column:
    """The cell restricted to ``keys``, in fixed order; unknown keys are an error."""
    if unknown := set(keys) - set(CELL):
        raise ValueError(f"unknown match keys {sorted(unknown)}; choose from {CELL}")
    short = {"category": "cat=", "subsystem": "sub=", "size_band": "size="}
    return F.concat_ws("|", *[F.concat(F.lit(short[k]), F.col(k)) for k in CELL if k in keys])


def greedy(cases: pd.DataFrame, controls: pd.DataFrame, key: str, fallback: bool) -> list[tuple[int, int, bool]]:
    """(case, control, relaxed): cases in ascending number take the nearest free control.

    Nearest is by score, then changed lines, then number, within the key; with ``fallback``, a
    case without any takes the nearest by category and size band in its subsystem.
    """
    controls = controls.sort_values("number").reset_index(drop=True)
    free = np.ones(len(controls), bool)
    number, score, lines = (controls[c].to_numpy() for c in ("number", "score", "changed_lines"))
    cat, band = controls["cat_rank"].to_numpy(), controls["band_rank"].to_numpy()
    pools = {k: np.asarray(v) for k, v in controls.groupby(key).indices.items()}
    wide = {k: np.asarray(v) for k, v in controls.groupby("subsystem").indices.items()}
    out = []
    for c in cases.sort_values("number").itertuples():
        for relaxed, pool in ((False, pools.get(getattr(c, key))), (True, wide.get(c.subsystem) if fallback else None)):
            if pool is None or not len(pool := pool[free[pool]]):
                continue
            order = [number[pool], np.abs(lines[pool] - c.changed_lines), np.abs(score[pool] - c.score)]
            if relaxed:
                order += [np.abs(band[pool] - c.band_rank), np.abs(cat[pool] - c.cat_rank)]
            best = pool[np.lexsort(order)[0]]
            free[best] = False
            out.append((c.number, int(number[best]), relaxed))
            break
    return out


def pairs(candidates: DataFrame, keys: Sequence[str] = CELL, fallback: bool = False, scope: Sequence[str] = ("repository",)) -> DataFrame:
    """(scope, positive, negative, relaxed) over ``candidates(scope, number, positive, score,
    changed_lines, category, subsystem, size_band)``.

    Pools never interact beyond a subsystem when the key holds it, so the work is split there;
    a key without it and no fallback splits by the key. Greedy matching is sequential inside
    such a group: at most the cases of one subsystem of one repository.
    """
    group = ["subsystem"] if "subsystem" in keys else [] if fallback else ["cell"]
    rows = candidates.withColumn("cell", cell_key(keys)).withColumn("cat_rank", category_rank(F.col("category"))).withColumn("band_rank", band_rank(F.col("size_band")))
    names = list(scope)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        got = greedy(pdf[pdf["is_positive"]], pdf[~pdf["is_positive"]], "cell", fallback)
        out = pd.DataFrame(got, columns=["positive", "negative", "relaxed"])
        for n in names:
            out[n] = pdf[n].iloc[0]
        return out

    ddl = "positive bigint, negative bigint, relaxed boolean" + "".join(f", {n} string" for n in names)
    return rows.groupBy(*names, *group).applyInPandas(match, ddl)
