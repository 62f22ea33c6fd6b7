"""Monotone fits that leave one factor level out, pooled where the rows are.

Rows collapse to sums per (level, x) and are cut into ranges of x. A range pools adjacent
violators for the fit of all rows and for each level that it holds, left out; ranges without
a level share the pools of all rows. Pools of neighbouring ranges are pooled again per
level, and predictions are read off where the level's own rows are. A range is a task's
load; no level and no fit passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelens.session import adapt, materialise

_POOLS = "level string, part int, low double, high double, low_part int, high_part int, weight double, total double"
_FITS = "level string, low double, high double, low_part int, high_part int, before_part int, after_part int, value double"


def pooled(low, high, weight, total) -> list[int]:
    """Adjacent violators pooled, from left to right: the first row of each pool.

    Rows ascend; a pool's mean is not below that of the pool before it.
    """
    first: list[int] = []
    w: list[float] = []
    t: list[float] = []
    for i in range(len(weight)):
        first.append(i)
        w.append(float(weight[i]))
        t.append(float(total[i]))
        while len(first) > 1 and t[-2] * w[-1] > t[-1] * w[-2]:
            first.pop()
            last_w, last_t = w.pop(), t.pop()
            w[-1] += last_w
            t[-1] += last_t
    return first


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Pools of sorted rows ``low, high, low_part, high_part, weight, total``."""
    if not len(rows):
        return rows
    first = pooled(*(rows[c].to_numpy() for c in ("low", "high", "weight", "total")))
    last = [*[i - 1 for i in first[1:]], len(rows) - 1]
    out = rows.iloc[first][["low", "low_part"]].reset_index(drop=True)
    out["high"], out["high_part"] = rows["high"].to_numpy()[last], rows["high_part"].to_numpy()[last]
    for c in ("weight", "total"):
        out[c] = np.add.reduceat(rows[c].to_numpy(float), first)
    return out


def _range(frame: pd.DataFrame) -> pd.DataFrame:
    """Pools of one range: of all its rows, and of all but those of each level in it."""
    part = int(frame["part"].iloc[0])
    x, place = np.unique(frame["x"].to_numpy(float), return_inverse=True)
    n = np.bincount(place, weights=frame["n"])
    y = np.bincount(place, weights=frame["y"])
    out = []
    for level in [None, *sorted(frame["level"].unique())]:
        left_n, left_y = n.copy(), y.copy()
        if level is not None:
            own = (frame["level"] == level).to_numpy()
            left_n -= np.bincount(place[own], weights=frame["n"][own], minlength=len(x))
            left_y -= np.bincount(place[own], weights=frame["y"][own], minlength=len(x))
        some = left_n > 0
        rows = pd.DataFrame({"low": x[some], "high": x[some], "weight": left_n[some], "total": left_y[some]})
        rows["low_part"] = rows["high_part"] = part
        rows = _merge(rows)
        rows["level"], rows["part"] = level, part
        out.append(rows)
    return pd.concat(out, ignore_index=True)[[c.split()[0] for c in _POOLS.split(", ")]]


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    """A level's final pools, with the ranges of their neighbours' near ends."""
    rows = _merge(frame.sort_values("low"))
    rows["level"] = frame["level"].iloc[0]
    rows["value"] = rows["total"] / rows["weight"]
    rows["before_part"] = rows["high_part"].shift(fill_value=-1)
    rows["after_part"] = rows["low_part"].shift(-1, fill_value=1 << 30)
    return rows[[c.split()[0] for c in _FITS.split(", ")]]


def _errors(key, rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
    """Rows of a level in one range: their number and the sum of squared errors."""
    if not len(rows):
        return pd.DataFrame({"level": pd.Series([], dtype=object), "n": [], "error": []})
    if not len(fits):
        return pd.DataFrame({"level": [key[0]], "n": [rows["n"].sum()], "error": [np.nan]})
    fits = fits.sort_values("low")
    at = np.ravel(fits[["low", "high"]].to_numpy())
    p = np.interp(rows["x"], at, np.repeat(fits["value"].to_numpy(), 2))
    error = (rows["y2"] - 2 * p * rows["y"] + rows["n"] * p * p).sum()
    return pd.DataFrame({"level": [key[0]], "n": [rows["n"].sum()], "error": [error]})


def leave_one_out(runs: DataFrame, metric: str, transfer: str, level: str, ranges: int | None = None) -> DataFrame:
    """Per level, by name: rows and mean squared error under the fit to all other levels.

    Rows with a null or NaN in any of the three columns take no part; a level without any
    other level to fit has a null error.
    """
    spark = adapt(runs.sparkSession)
    x, y = F.col(metric).cast("double"), F.col(transfer).cast("double")
    rows = runs.select(F.col(level).cast("string").alias("level"), x.alias("x"), y.alias("t"))
    rows = rows.filter("level is not null and x is not null and not isnan(x) and t is not null and not isnan(t)")
    sums = rows.groupBy("level", "x").agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").alias("y"), F.sum(F.col("t") * F.col("t")).alias("y2")
    )
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(sums.repartitionByRange(count, "x").withColumn("part", F.spark_partition_id()))
    pools = materialise(cut.groupBy("part").applyInPandas(_range, _POOLS))
    # Which pools a level reads in each range: its own where it has rows, else those of all rows.
    present = cut.select("level", "part").distinct().withColumn("source", F.col("level"))
    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("part")
    wanted = cut.select("level").distinct().select(F.col("level").alias("reader"), every)
    wanted = wanted.join(present.withColumnRenamed("level", "reader"), ["reader", "part"], "left")
    meet = wanted["source"].eqNullSafe(pools["level"]) & (wanted["part"] == pools["part"])
    read = wanted.join(pools, meet).select(
        F.col("reader").alias("level"), "low", "high", "low_part", "high_part", "weight", "total"
    )
    fits = read.groupBy("level").applyInPandas(_fit, _FITS)
    # A pool is needed from the range of the pool before it to that of the pool after it.
    first = F.greatest("before_part", F.lit(0))
    last = F.least("after_part", F.lit(count - 1))
    placed = fits.select("level", "low", "high", "value", F.explode(F.sequence(first, last)).alias("part"))
    errors = cut.groupBy("level", "part").cogroup(placed.groupBy("level", "part")).applyInPandas(
        _errors, "level string, n long, error double"
    )
    total = errors.groupBy("level").agg(F.sum("n").alias("runs"), F.sum("error").alias("error"))
    return total.select("level", "runs", (F.when(~F.isnan("error"), F.col("error")) / F.col("runs")).alias("mse"))
