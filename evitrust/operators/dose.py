"""Dose-response: block prediction and Hill fits per (entity, channel)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evitrust.sources import shared

# Bounds of the fit and the response below which a curve counts as censored.
IC50_BOUNDS = (1e-6, 1e6)
HILL_BOUNDS = (0.1, 5.0)
HALF_BLOCK = 50.0
MIN_POINTS = 3

MAX_POINTS_IN_TASK = 10_000
MAX_STEPS = 60
_LOG_BOUNDS = (float(np.log(IC50_BOUNDS[0])), float(np.log(IC50_BOUNDS[1])))


def hill_block(conc: Column, ic50: Column, hill: Column) -> Column:
    """1/(1+(ic50/conc)^n); 0 at concentration 0, null where the value is not finite."""
    ratio = F.try_divide(ic50, conc)
    out = F.when((conc == 0) & (ic50 > 0) & (hill > 0), 0.0).otherwise(
        F.try_divide(F.lit(1.0), 1 + F.pow(ratio, hill)))
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


def mean_responses(df: DataFrame, keys: Sequence[str], conc: str, response: str) -> DataFrame:
    """One point per (keys, concentration): the mean response."""
    ok = F.col(conc).isNotNull() & F.col(response).isNotNull() & ~F.isnan(conc) & ~F.isnan(response)
    return df.where(ok).groupBy(*keys, F.col(conc).alias("conc")).agg(F.avg(response).alias("response"))


def curve_rules(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: number of points, kind of result (NA, censored, fit) and a starting point for the fit.

    The start is the straight line through the logits, one partial aggregate.
    """
    inside = (F.col("response") > 0) & (F.col("response") < 100) & (F.col("conc") > 0)
    x = F.when(inside, F.log("conc"))
    y = F.when(inside, F.log(F.col("response") / (100 - F.col("response"))))
    n, sx, sy = F.count(x), F.sum(x), F.sum(y)
    sxx, sxy = F.sum(x * x), F.sum(x * y)
    stats = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.max("response").alias("_top"), F.max("conc").alias("_max_conc"),
        n.alias("_n"), sx.alias("_sx"), sy.alias("_sy"), sxx.alias("_sxx"), sxy.alias("_sxy"),
        F.avg(F.when(F.col("conc") > 0, F.log("conc"))).alias("_mid"))
    det = F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    slope = F.when((F.col("_n") > 1) & (det > 1e-12), (F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / F.when(det > 1e-12, det))
    stats = stats.withColumn("_slope", slope)
    good = F.col("_slope") > 1e-6
    at = F.when(good, -(F.col("_sy") - F.col("_slope") * F.col("_sx")) / (F.col("_n") * F.when(good, F.col("_slope"))))
    bounded = lambda c, b: F.greatest(F.least(c, F.lit(b[1])), F.lit(b[0]))
    kind = F.when(F.col("n_points") < MIN_POINTS, "NA").when(F.col("_top") < HALF_BLOCK, ">").otherwise("=")
    return stats.select(
        *keys, "n_points", kind.alias("relation"), F.col("_max_conc"),
        bounded(F.coalesce(at, F.col("_mid"), F.lit(0.0)), _LOG_BOUNDS).alias("_u"),
        bounded(F.coalesce(F.when(good, F.col("_slope")), F.lit(1.0)), HILL_BOUNDS).alias("_h"))


def _sums(x: np.ndarray, y: np.ndarray, u: float, h: float):
    """Squared error, normal matrix and right-hand side at (log ic50, n)."""
    z = np.clip(h * (u - x), -500, 500)
    f = 100.0 / (1.0 + np.exp(z))
    slope = -f * (100.0 - f) / 100.0
    r, ju, jh = y - f, slope * h, slope * (u - x)
    return (r @ r, ju @ ju, ju @ jh, jh @ jh, ju @ r, jh @ r)


def _step(u: float, h: float, s, damping: float) -> tuple[float, float]:
    a, b, c = s[1] * (1 + damping) + 1e-12, s[2], s[3] * (1 + damping) + 1e-12
    det = a * c - b * b
    if not det > 0:
        return u, h
    du, dh = (c * s[4] - b * s[5]) / det, (a * s[5] - b * s[4]) / det
    return (min(max(u + du, _LOG_BOUNDS[0]), _LOG_BOUNDS[1]), min(max(h + dh, HILL_BOUNDS[0]), HILL_BOUNDS[1]))


def _refine(x: np.ndarray, y: np.ndarray, u: float, h: float) -> tuple[float, float]:
    """Damped Gauss-Newton inside the bounds."""
    s, damping = _sums(x, y, u, h), 1e-3
    for _ in range(MAX_STEPS):
        nu, nh = _step(u, h, s, damping)
        moved = max(abs(nu - u), abs(nh - h))
        if moved < 1e-12:
            break
        t = _sums(x, y, nu, nh)
        if t[0] <= s[0]:
            u, h, s, damping = nu, nh, t, damping / 10
        else:
            damping *= 10
            if damping > 1e12:
                break
    return u, h


def _fit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fits = [
            _refine(np.array([p["x"] for p in pts]), np.array([p["y"] for p in pts]), u, h)
            for pts, u, h in zip(b["_pts"], b["_u"], b["_h"])
        ]
        yield b.drop(columns=["_pts"]).assign(_u=[f[0] for f in fits], _h=[f[1] for f in fits])


def _fit_distributed(points: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same damped steps for curves with very many points: every step is one partially aggregated
    pass over the points, and only the parameters (one row per curve) are carried on."""
    names = ["_c", "_a", "_b", "_d", "_g", "_e"]
    state = starts.select(*keys, "_u", "_h", F.lit(1e-3).alias("_damp"), F.col("_u").alias("_tu"), F.col("_h").alias("_th"),
                          *[F.lit(None).cast("double").alias(n) for n in names], F.lit(False).alias("_done"))
    pts = points.where(F.col("conc") > 0).select(*keys, F.log("conc").alias("_x"), F.col("response").alias("_y"))
    for _ in range(MAX_STEPS):
        trial = state.where(~F.col("_done")).select(*keys, "_tu", "_th")
        z = F.col("_th") * (F.col("_tu") - F.col("_x"))
        f = F.lit(100.0) / (1 + F.exp(F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))
        work = pts.join(trial, list(keys)).withColumn("_f", f)
        slope = -F.col("_f") * (100 - F.col("_f")) / 100
        ju, jh, r = slope * F.col("_th"), slope * (F.col("_tu") - F.col("_x")), F.col("_y") - F.col("_f")
        new = work.groupBy(*keys).agg(*[F.sum(e).alias("n" + n) for n, e in zip(
            names, [r * r, ju * ju, ju * jh, jh * jh, ju * r, jh * r])])
        s = state.join(new, list(keys), "left")
        better = F.coalesce(F.col("n_c").isNotNull() & (F.col("_c").isNull() | (F.col("n_c") <= F.col("_c"))), F.lit(False))
        keep = lambda a, b: F.when(better, F.col(a)).otherwise(F.col(b))
        s = s.select(*keys, keep("_tu", "_u").alias("_u"), keep("_th", "_h").alias("_h"),
                     F.when(F.col("_done"), F.col("_damp")).when(better, F.col("_damp") / 10).otherwise(F.col("_damp") * 10).alias("_damp"),
                     *[keep("n" + n, n).alias(n) for n in names], "_done")
        a = F.col("_a") * (1 + F.col("_damp")) + 1e-12
        d = F.col("_d") * (1 + F.col("_damp")) + 1e-12
        det = a * d - F.col("_b") * F.col("_b")
        ok = F.coalesce(det > 0, F.lit(False))
        safe = F.when(ok, det)
        du = F.when(ok, (d * F.col("_g") - F.col("_b") * F.col("_e")) / safe).otherwise(0.0)
        dh = F.when(ok, (a * F.col("_e") - F.col("_b") * F.col("_g")) / safe).otherwise(0.0)
        s = s.withColumns({
            "_tu": F.greatest(F.least(F.col("_u") + du, F.lit(_LOG_BOUNDS[1])), F.lit(_LOG_BOUNDS[0])),
            "_th": F.greatest(F.least(F.col("_h") + dh, F.lit(HILL_BOUNDS[1])), F.lit(HILL_BOUNDS[0]))})
        moved = F.greatest(F.abs(F.col("_tu") - F.col("_u")), F.abs(F.col("_th") - F.col("_h")))
        s = s.withColumn("_done", F.col("_done") | (moved < 1e-12) | (F.col("_damp") > 1e12))
        state = s.checkpoint()  # one small row per curve; cuts the lineage of the loop
        if state.where(~F.col("_done")).limit(1).count() == 0:
            break
    return state.select(*keys, "_u", "_h")


def fit_curves(df: DataFrame, keys: Sequence[str], conc: str, response: str,
               max_points_in_task: int = MAX_POINTS_IN_TASK) -> DataFrame:
    """(keys, ic50, hill_n, relation, n_points) for every curve.

    Fewer than three concentrations give ``NA``; a top response below 50 gives ``>`` with the highest
    concentration; otherwise a bounded least-squares Hill fit. Curves with more points than one task
    should hold are fitted by distributed steps, which write their parameters to the checkpoint folder of
    the session; all others are fitted in batches of curves.
    """
    keys = list(keys)
    points = mean_responses(df, keys, conc, response)
    rules = curve_rules(points, keys)
    to_fit = rules.where(F.col("relation") == "=")
    small = to_fit.where(F.col("n_points") <= max_points_in_task).select(*keys, "_u", "_h")
    pts = points.where(F.col("conc") > 0).join(small, keys).groupBy(*keys, "_u", "_h").agg(
        F.collect_list(F.struct(F.log("conc").alias("x"), F.col("response").alias("y"))).alias("_pts"))
    kinds = dict(points.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _u double, _h double"
    fitted = pts.mapInPandas(_fit_batches, schema)
    large = to_fit.where(F.col("n_points") > max_points_in_task)
    if large.limit(1).count():
        spark = df.sparkSession
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared.folder(spark))
        big_points = points.join(large.select(*keys), keys, "left_semi")
        fitted = fitted.unionByName(_fit_distributed(big_points, large, keys))
    out = rules.drop("_u", "_h").join(fitted, keys, "left")
    is_fit = F.col("relation") == "="
    found = is_fit & F.col("_u").isNotNull()
    return out.select(
        *keys,
        F.when(found, F.exp("_u")).when(F.col("relation") == ">", F.col("_max_conc")).alias("ic50"),
        F.when(found, F.col("_h")).alias("hill_n"),
        F.when(is_fit & ~found, "NA").otherwise(F.col("relation")).alias("relation"),
        "n_points")


def fitted_cells(fits: DataFrame, source: str, prio: int, censored_as_value: bool = True) -> DataFrame:
    """Fits as rows of the long cell table. By default a censored curve enters with its limit as the
    value; without, only exact fits are kept."""
    kept = fits.where(F.col("ic50").isNotNull())
    if not censored_as_value:
        kept = kept.where(F.col("relation") == "=")
    return kept.select("entity", "channel", F.lit(source).alias("source"), F.lit(prio).alias("prio"),
                       F.col("ic50").alias("value"), F.col("n_points").alias("n_records"),
                       F.lit(False).alias("is_strict"), "relation")


def exact_fit_cells(fits: DataFrame, keys: Sequence[str] = ("entity", "channel"), **sizing) -> DataFrame:
    """Median and count of exact fits per cell (for tables that hold several fits per cell)."""
    from evitrust import ordering
    exact = fits.where((F.col("relation") == "=") & F.col("ic50").isNotNull())
    n = exact.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"))
    return n.join(ordering.grouped_median(exact, list(keys), "ic50", "value", **sizing), list(keys))
