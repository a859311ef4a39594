"""Feature preparation, models, calibration and out-of-fold prediction with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from evitrust import ordering
from evitrust.functions import probs
from evitrust.operators import curves, fold_models, folds as fold_ops, harmonize, late_fusion, metrics
from evitrust.sources.shared import written

MIN_ISOTONIC_PER_CLASS = 50
ROWS_PER_HASH_RANGE = 100_000


# --- features --------------------------------------------------------------------------------

@dataclass
class Preparation:
    """What was learned from the train rows: fill values, scales and the category encoder."""

    fills: dict[str, str]
    medians: dict[str, float]
    centre: dict[str, float]
    scale: dict[str, float]
    encoder: PipelineModel | None
    categorical: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    def numeric_columns(self) -> dict[str, Column]:
        """Imputed and scaled numeric columns as expressions."""
        return {
            c: (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(self.centre[c])) / F.lit(self.scale[c])
            for c, m in self.medians.items()
        }

    def apply(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Add the assembled vector; categories not seen in training encode as zeros."""
        work = df.withColumns({f"_x_{c}": e for c, e in self.numeric_columns().items()})
        inputs = [f"_x_{c}" for c in self.medians]
        if self.encoder is not None:
            work = work.withColumns({f"_s_{c}": F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in self.fills.items()})
            work = self.encoder.transform(work)
            inputs = [f"_o_{c}" for c in self.fills] + inputs
        vec = VectorAssembler(inputCols=inputs, outputCol=out).transform(work)
        return vec.select(*df.columns, out)


def numeric_medians(df: DataFrame, columns: Sequence[str], **sizing) -> DataFrame:
    """Exact medians of all columns in one job: (column_name, median); all-null columns are absent."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")).select("s.*")
    return ordering.grouped_median(long.where(~F.isnan("value")), ["column_name"], "value", "median", **sizing)


def fit_preparation(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                    scale: bool = True, with_mean: bool = True, **sizing) -> Preparation:
    """Learn imputation, scaling and encoding from train rows only.

    Columns without any train value are dropped, as nothing can be learned about them.
    """
    if numeric and "group_at_most" not in sizing:
        sizing = {**sizing, "group_at_most": train.count()}
    medians = {r["column_name"]: r["median"] for r in numeric_medians(train, numeric, **sizing).collect()} if numeric else {}
    medians = {c: medians[c] for c in numeric if c in medians}
    centre, spread = {c: 0.0 for c in medians}, {c: 1.0 for c in medians}
    if scale and medians:
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()}
        row = train.agg(*[F.avg(e).alias(f"m_{c}") for c, e in filled.items()],
                        *[F.stddev_pop(e).alias(f"s_{c}") for c, e in filled.items()]).first()
        for c in medians:
            spread[c] = row[f"s_{c}"] or 1.0
            centre[c] = row[f"m_{c}"] if with_mean else 0.0
    fills = {}
    if categorical:
        stacked = train.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in categorical
        ])).alias("s")).select("s.*")
        top = {r["column_name"]: r["value"] for r in
               harmonize.most_frequent(stacked, ["column_name"], "value").collect()}  # one row per column
        fills = {c: top[c] for c in categorical if c in top}
    encoder = None
    if fills:
        text = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit(v)).alias(f"_s_{c}") for c, v in fills.items()])
        index = StringIndexer(inputCols=[f"_s_{c}" for c in fills], outputCols=[f"_i_{c}" for c in fills],
                              handleInvalid="keep", stringOrderType="alphabetAsc")
        hot = OneHotEncoder(inputCols=[f"_i_{c}" for c in fills], outputCols=[f"_o_{c}" for c in fills], dropLast=True)
        encoder = Pipeline(stages=[index, hot]).fit(text)
    lost = [c for c in [*categorical, *numeric] if c not in fills and c not in medians]
    return Preparation(fills, medians, centre, spread, encoder, list(fills), lost)


def encoded_shape(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> tuple[int, int]:
    """Rows and columns of the encoded train matrix."""
    encoded = fit_preparation(train, categorical, numeric).apply(train)
    width = F.size(vector_to_array("features"))
    row = encoded.agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("w")).first()
    return row["n"], row["w"]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return counts.join(F.broadcast(total)).select(  # one row
        label, "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))


# --- models ----------------------------------------------------------------------------------

def label_index(label: str, labels: Sequence[str]) -> Column:
    out = F.lit(None).cast("double")
    for i, x in enumerate(labels):
        out = F.when(F.col(label) == x, F.lit(float(i))).otherwise(out)
    return out


@dataclass
class Classifier:
    """A fitted model that always yields one probability column per label, in label order."""

    labels: list[str]
    model: object = None
    per_class: dict[int, object] = field(default_factory=dict)
    only_class: int | None = None

    def predict(self, df: DataFrame, prefix: str = "prob_") -> DataFrame:
        names = [f"{prefix}{x}" for x in self.labels]
        if self.only_class is not None:
            return df.withColumns({n: F.lit(1.0 if i == self.only_class else 0.0) for i, n in enumerate(names)})
        if self.model is not None:
            out = self.model.transform(df).withColumn("_p", vector_to_array("probability"))
            cols = [F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)) for i in range(len(names))]
        else:
            out = df
            for i, m in self.per_class.items():
                out = m.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1])
                out = out.drop("rawPrediction", "probability", "prediction")
            cols = [F.col(f"_p{i}") if i in self.per_class else F.lit(0.0) for i in range(len(names))]
        scaled = probs.normalized(cols)
        return out.select(*df.columns, *[c.alias(n) for c, n in zip(scaled, names)])


def fit_classifier(train: DataFrame, kind: str, labels: Sequence[str], label: str = "y_true",
                   features: str = "features", balanced: bool = True, seed: int = 42, **params) -> Classifier:
    """``logistic`` (multinomial), ``forest`` or ``boosting`` (one binary model per class).

    With a single class in the train rows the result is that class with probability 1.
    """
    labels = list(labels)
    work = train.withColumn("_y", label_index(label, labels)).where(F.col("_y").isNotNull())
    weights = class_weights(work, "_y")
    present = sorted(int(r["_y"]) for r in weights.select("_y").collect())  # one row per class
    if len(present) < 2:
        return Classifier(labels, only_class=present[0] if present else 0)
    if balanced:
        work = work.join(weights.select("_y", F.col("weight").alias("_w")), "_y")
    else:
        work = work.withColumn("_w", F.lit(1.0))
    work = work.select("_y", "_w", F.col(features)).persist(StorageLevel.MEMORY_AND_DISK)
    common = {"featuresCol": features, "weightCol": "_w"}
    try:
        if kind == "logistic":
            model = LogisticRegression(labelCol="_y", family="multinomial", maxIter=params.get("max_iter", 1000),
                                       regParam=params.get("reg", 0.0), **common)
            return Classifier(labels, model=model.fit(work))
        if kind == "forest":
            model = RandomForestClassifier(labelCol="_y", numTrees=params.get("trees", 200),
                                           maxDepth=params.get("depth", 10), seed=seed, **common)
            return Classifier(labels, model=model.fit(work))
        if kind == "boosting":
            fitted = {}
            for i in present:
                one = work.withColumn("_t", (F.col("_y") == i).cast("double"))
                fitted[i] = GBTClassifier(labelCol="_t", maxIter=params.get("max_iter", 20),
                                          maxDepth=params.get("depth", 5), seed=seed, **common).fit(one)
            return Classifier(labels, per_class=fitted)
    finally:
        work.unpersist()
    raise ValueError(f"unknown model {kind}")


# --- calibration -----------------------------------------------------------------------------

@dataclass
class Calibrator:
    """One map per class from raw to calibrated probability, then renormalized."""

    labels: list[str]
    maps: dict[int, object]
    isotonic: bool

    def apply(self, df: DataFrame, prefix: str = "prob_") -> DataFrame:
        names = [f"{prefix}{x}" for x in self.labels]
        out = df
        for i, m in self.maps.items():
            out = out.withColumn("_s", array_to_vector(F.array(names[i])))
            if self.isotonic:
                out = m.transform(out).withColumn(f"_c{i}", F.col("prediction")).drop("prediction")
            else:
                out = m.transform(out).withColumn(f"_c{i}", vector_to_array("probability")[1]).drop(
                    "rawPrediction", "probability", "prediction")
        cols = [F.col(f"_c{i}") if i in self.maps else F.lit(0.0) for i in range(len(names))]
        rest = [c for c in df.columns if c not in names]
        return out.select(*rest, *[c.alias(n) for c, n in zip(probs.normalized(cols), names)])


def isotonic_means(df: DataFrame, score: str, hit: str, increasing: bool = True) -> DataFrame:
    """(score, mean) for each distinct score: the monotone step map of the mean of ``hit``.

    Rows are folded to one weighted point a score before the fit, so the points are as many as distinct scores.
    """
    points = df.groupBy(score).agg(F.avg(hit).alias("_t"), F.count(F.lit(1)).cast("double").alias("_w")).withColumn(
        "_s", array_to_vector(F.array(score)))
    model = IsotonicRegression(featuresCol="_s", labelCol="_t", weightCol="_w", isotonic=increasing).fit(points)
    return model.transform(points).select(score, F.col("prediction").alias("mean"))


def _class_counts(calib: DataFrame, labels: Sequence[str], label: str) -> dict[str, int]:
    counts = {r[label]: r["n"] for r in calib.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .where(F.col(label).isin(list(labels))).collect()}
    return {x: counts.get(x, 0) for x in labels}


def isotonic_gate(counts: Mapping[str, int], at_least: int = MIN_ISOTONIC_PER_CLASS) -> str | None:
    """Reason not to fit isotonic maps, or None."""
    missing = [x for x, n in counts.items() if n == 0]
    if missing:
        return f"missing classes in calibration rows: {missing}"
    low = [x for x, n in counts.items() if n < at_least]
    return f"fewer than {at_least} calibration rows for: {low}" if low else None


def fit_calibrator(calib: DataFrame, method: str, labels: Sequence[str], label: str = "y_true",
                   prefix: str = "prob_") -> Calibrator:
    """``sigmoid``: logistic map per class on smoothed targets; ``isotonic``: monotone step map."""
    labels = list(labels)
    counts = _class_counts(calib, labels, label)
    n = sum(counts.values())
    maps = {}
    for i, x in enumerate(labels):
        hit = F.col(label) == x
        scored = calib.select(array_to_vector(F.array(f"{prefix}{x}")).alias("_s"), hit.alias("_hit"))
        if counts[x] == 0 or counts[x] == n:
            continue  # a class that is absent, or the only one, has no map
        if method == "isotonic":
            # one weighted point a score (to 6 digits): the driver pools points, not rows
            points = calib.groupBy(F.round(f"{prefix}{x}", 6).alias("_p")).agg(
                F.avg(hit.cast("double")).alias("_t"), F.count(F.lit(1)).cast("double").alias("_w")).withColumn(
                    "_s", array_to_vector(F.array("_p")))
            maps[i] = IsotonicRegression(featuresCol="_s", labelCol="_t", weightCol="_w").fit(points)
        else:
            high, low = (counts[x] + 1.0) / (counts[x] + 2.0), 1.0 / (n - counts[x] + 2.0)
            target = F.when(F.col("_hit"), high).otherwise(low)
            rows = scored.select("_s", F.explode(F.array(
                F.struct(F.lit(1.0).alias("t"), target.alias("w")),
                F.struct(F.lit(0.0).alias("t"), (1 - target).alias("w")))).alias("z")).select("_s", "z.*")
            maps[i] = LogisticRegression(featuresCol="_s", labelCol="t", weightCol="w", maxIter=200).fit(rows)
    return Calibrator(labels, maps, method == "isotonic")


# --- out-of-fold runs ------------------------------------------------------------------------

@dataclass(frozen=True)
class FeatureSet:
    name: str
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]


@dataclass(frozen=True)
class RunSpec:
    """One combination of model and calibration (none, sigmoid, isotonic, temperature)."""

    model: str
    calibration: str = "none"
    params: tuple[tuple[str, object], ...] = ()


def _slots(roles: DataFrame) -> list[tuple[int, int]]:
    return sorted((r["seed"], r["fold"]) for r in roles.select("seed", "fold").distinct().collect())


def _fold_rows(rows: DataFrame, roles: DataFrame, seed: int, fold: int, group: str) -> DataFrame:
    slot = roles.where((F.col("seed") == seed) & (F.col("fold") == fold)).select(group, "role")
    return rows.join(slot, group)


def predict_fold(rows: DataFrame, roles: DataFrame, seed: int, fold: int, features: FeatureSet, spec: RunSpec,
                 labels: Sequence[str], group: str, label: str = "y_true") -> tuple[DataFrame | None, str, str]:
    """Fit on train, calibrate on calib, predict test of one (seed, fold): (predictions, status, reason)."""
    return predict_fold_all(rows, roles, seed, fold, features, [spec], labels, group, label)[0]


def predict_fold_all(rows: DataFrame, roles: DataFrame, seed: int, fold: int, features: FeatureSet, specs: Sequence[RunSpec],
                     labels: Sequence[str], group: str, label: str = "y_true") -> list[tuple[DataFrame | None, str, str]]:
    """The same for several runs of one (seed, fold). Runs that learn from the same rows share preparation and model,
    whatever their calibrations are."""
    named = _fold_rows(rows, roles, seed, fold, group).persist(StorageLevel.MEMORY_AND_DISK)  # for the fitting jobs
    try:
        shared: dict = {}
        return [_fit_and_predict(named, seed, fold, features, spec, labels, group, label, shared) for spec in specs]
    finally:
        named.unpersist()  # predictions are lazy; they read their test rows again


def _fit_and_predict(named: DataFrame, seed: int, fold: int, features: FeatureSet, spec: RunSpec, labels: Sequence[str],
                     group: str, label: str, shared: dict) -> tuple[DataFrame | None, str, str]:
    train_roles = ("train", "calib") if spec.calibration == "none" else ("train",)
    train = named.where(F.col("role").isin(list(train_roles)))
    ready = lambda prep, d: prep.apply(d.where(F.col(label).isNotNull()))
    if ("prep", train_roles) not in shared:
        shared["prep", train_roles] = fit_preparation(train, features.categorical, features.numeric)
    prep = shared["prep", train_roles]
    key = (train_roles, spec.model, spec.params)
    if key not in shared:
        shared[key] = fit_classifier(ready(prep, train), spec.model, labels, label, seed=seed, **dict(spec.params))
    fitted = shared[key]
    keep = ["row_id", group, label]
    cols = [f"prob_{x}" for x in labels]
    test = fitted.predict(ready(prep, named.where("role = 'test'"))).select(*keep, *cols)
    test = test.withColumns({f"prob_raw_{x}": F.col(f"prob_{x}") for x in labels})
    raw = [f"prob_raw_{x}" for x in labels]
    if spec.calibration != "none":
        calib = fitted.predict(ready(prep, named.where("role = 'calib'"))).select(*keep, *cols)
        if spec.calibration == "isotonic":
            reason = isotonic_gate(_class_counts(calib, labels, label))
            if reason:
                return None, "SKIP", reason
        if spec.calibration == "temperature":
            losses = late_fusion.temperature_losses(
                calib.withColumnsRenamed({label: "y_true"}).withColumn("_k", F.lit(0)), ["_k"], cols, labels)
            best = late_fusion.select_temperature(losses, ["_k"])
            test = late_fusion.apply_temperature(test.withColumn("_k", F.lit(0)), best, ["_k"], cols, labels).select(*keep, *cols, *raw)
        else:
            test = fit_calibrator(calib, spec.calibration, labels, label).apply(test)
    final = [F.col(c) for c in cols]
    out = test.select(
        "row_id", F.lit(seed).alias("seed"), F.lit(fold).alias("fold"), F.lit("test").alias("split_role"),
        group, F.col(label).alias("y_true"), probs.arg_max(final, labels).alias("y_pred"),
        F.greatest(*final).alias("confidence"), *final,
        probs.arg_max([F.col(c) for c in raw], labels).alias("y_pred_raw"), *raw)
    return out, "OK", ""


JOINT_MODELS = ("logistic", "boosting", "forest")
FITS_AT_ONCE = 4
MAX_COEFFICIENTS = 600        # of a model whose Newton steps are solved on the driver; wider ones are fitted fold by fold
MAX_POOLS = 1_000_000         # of all isotonic maps of a run, which go to the tasks


def _joint(ft: fold_models.FoldTable | None, model: str, labels: Sequence[str]) -> bool:
    """Are all folds of the model fitted together? Not those of logistic models with very many columns."""
    return ft is not None and (model != "logistic" or fold_models.width(ft) * len(labels) <= MAX_COEFFICIENTS)


def out_of_fold_all(rows: DataFrame, roles: DataFrame, features: FeatureSet, specs: Sequence[RunSpec], labels: Sequence[str],
                    group: str, label: str = "y_true", table: fold_models.FoldTable | None = None) -> list[tuple[DataFrame | None, str, str]]:
    """Predictions of every (seed, fold), one result for each run.

    Logistic and boosted models and forests of all folds are fitted together (see ``fold_models``); runs that differ in
    calibration only share their fits. Logistic models with very many columns are fitted fold by fold with Spark ML,
    ``FITS_AT_ONCE`` side by side. Calibrated runs also hold the probabilities and labels before calibration
    (``prob_raw_*``, ``y_pred_raw``). ``table`` is the coded table of these rows and roles, if there is one.
    """
    slots = table.slots if table else _slots(roles)
    by_model: dict[tuple, list[int]] = {}
    for i, spec in enumerate(specs):
        by_model.setdefault((spec.model, spec.params), []).append(i)
    out: list = [None] * len(specs)
    apart = []
    for (model, params), at in by_model.items():
        if model in JOINT_MODELS:
            table = table or fold_models.fold_table(rows, roles, features.categorical, features.numeric, labels, group, label, slots)
            if _joint(table, model, labels):
                for i, done in zip(at, _joint_runs(table, model, dict(params), [specs[i].calibration for i in at])):
                    out[i] = done
                continue
        apart += at
    if apart:
        roles = written(roles.select(group, "seed", "fold", "role"))      # read once a fold
        work = inheritable_thread_target(rows.sparkSession)(
            lambda slot: predict_fold_all(rows, roles, *slot, features, [specs[i] for i in apart], labels, group, label))
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            parts = list(pool.map(work, slots))
        for i, runs in zip(apart, zip(*parts)):
            bad = [r for r in runs if r[0] is None]
            out[i] = (None, *bad[0][1:]) if bad else (reduce(DataFrame.unionByName, [r[0] for r in runs]), "OK", "")
    return out


@dataclass
class _JointFit:
    """Models of all slots: fits on train and calibration rows for no calibration, on train rows for any. Scores of the
    calibration rows are packed once for all runs that ask for them."""

    ft: fold_models.FoldTable
    fits: list[fold_models.Fit]
    prep: fold_models.Prepared
    fitted: object
    _packed: fold_models.Packed | None = None

    @classmethod
    def of(cls, ft: fold_models.FoldTable, model: str, params: dict, calibrations: Sequence[str]) -> _JointFit:
        need = sorted({c == "none" for c in calibrations})
        fits = [fold_models.Fit(s, w) for w in need for s in range(len(ft.slots))]
        prep = fold_models.prepare(ft, fits, params.pop("balanced", True))
        fit = {"logistic": fold_models.fit_logistic, "boosting": fold_models.fit_boosting, "forest": fold_models.fit_forest}[model]
        return cls(ft, fits, prep, fit(ft, fits, prep, **params))

    def packed(self) -> fold_models.Packed:
        if self._packed is None:
            self._packed = fold_models.packed_scores(self.ft, self.fits, self.prep, self.fitted)
        return self._packed

    def isotonic_reason(self) -> str | None:
        """Why isotonic maps are not fitted, by the first slot that says so."""
        k, sizes = len(self.ft.labels), self.packed().sizes
        if not sizes:
            return "no calibration rows"
        reasons = [isotonic_gate({x: sizes[s * k + c][1] for c, x in enumerate(self.ft.labels)}) for s in range(len(self.ft.slots)) if s * k in sizes]
        return next((r for r in reasons if r), None)

    def sigmoids(self) -> dict[int, tuple[float, float]]:
        return fold_models.packed_sigmoids(self.packed())

    def lines(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Points of the step maps, straight between pools. A class with no hit, or no miss, in a slot has no map."""
        found = fold_models.packed_pools(self.packed()).limit(MAX_POOLS + 1).collect()
        if len(found) > MAX_POOLS:
            raise ValueError(f"more than {MAX_POOLS} pools")
        usable, pools = set(self.packed().usable()), {}
        for r in found:
            if r["_key"] in usable:
                pools.setdefault(r["_key"], []).append((r.lo, r.hi, r["mean"]))
        lines = {}
        for key, pool in pools.items():
            lo, hi, mean = np.array(sorted(pool)).T
            lines[key] = np.stack([lo, hi], axis=1).ravel(), np.repeat(mean, 2)
        return lines

    def temperatures(self) -> dict[int, float]:
        """The temperature of each slot with the lowest loss, the smaller one on ties."""
        losses = fold_models.temperature_sums(self.ft, self.fits, self.prep, self.fitted, late_fusion.TEMPERATURES,
                                              late_fusion.TEMPERATURE_CLIP, metrics.LOG_LOSS_EPS)
        return {slot: min(zip(v.tolist(), late_fusion.TEMPERATURES))[1] for slot, v in losses.items()}

    def change(self, calibration: str):
        """A function of slot and probabilities that gives the calibrated ones (None where a slot has none), or None for no
        calibration."""
        k = len(self.ft.labels)
        if calibration == "none":
            return None
        if calibration == "temperature":
            chosen = self.temperatures()
            return lambda slot, p: _even(p ** (1.0 / chosen[slot]) if chosen[slot] != 1.0 else p) if slot in chosen else None
        if calibration == "sigmoid":
            return _by_class({key: (lambda x, a=a, b=b: 1 / (1 + np.exp(-(a * x + b)))) for key, (a, b) in self.sigmoids().items()}, k)
        return _by_class({key: (lambda x, line=line: np.interp(x, *line)) for key, line in self.lines().items()}, k)


def _even(p: np.ndarray) -> np.ndarray:
    """Rows scaled to sum 1; an all-zero row becomes uniform."""
    total = p.sum(axis=1, keepdims=True)
    return np.where(total > 0, p / np.where(total > 0, total, 1.0), 1.0 / p.shape[1])


def _by_class(maps: Mapping[int, object], k: int):
    """A map of one class each, then scaled; a class without a map gets 0."""
    return lambda slot, p: _even(np.column_stack([maps[slot * k + c](p[:, c]) if slot * k + c in maps else np.zeros(len(p)) for c in range(k)]))


def _joint_runs(ft: fold_models.FoldTable, model: str, params: dict, calibrations: Sequence[str]) -> list[tuple[DataFrame | None, str, str]]:
    """The runs of one model on all slots."""
    joint = _JointFit.of(ft, model, params, calibrations)
    labels, names, fits = ft.labels, [f"prob_{x}" for x in ft.labels], joint.fits
    test = fold_models.predictions(ft, fits, joint.prep, joint.fitted, [fold_models.TEST]).where("y >= 0")
    if model != "logistic" or len(calibrations) > 1:
        test = written(test)      # else read once, and soon made
    slot_of = F.element_at(F.array(*[F.lit(f.slot) for f in fits]), F.col("fit") + 1)
    with_calib = F.element_at(F.array(*[F.lit(f.with_calib) for f in fits]), F.col("fit") + 1)
    out = []
    for calibration in calibrations:
        if calibration == "isotonic" and (reason := joint.isotonic_reason()):
            out.append((None, "SKIP", reason))
            continue
        own = test.where(with_calib == (calibration == "none")).select("row_id", ft.group, "y", slot_of.alias("_s"), F.col("p").alias("raw"), "p")
        change = joint.change(calibration)
        if change is not None:
            own = own.mapInArrow(_changed(change, len(labels)), own.schema)
        seed, fold = ([F.lit(s[j]) for s in ft.slots] for j in (0, 1))
        final, raw = [F.col("p")[i] for i in range(len(labels))], [F.col("raw")[i] for i in range(len(labels))]
        out.append((own.select(
            "row_id", F.element_at(F.array(*seed), F.col("_s") + 1).alias("seed"), F.element_at(F.array(*fold), F.col("_s") + 1).alias("fold"),
            F.lit("test").alias("split_role"), ft.group, F.element_at(F.array(*map(F.lit, labels)), F.col("y") + 1).alias("y_true"),
            probs.arg_max(final, labels).alias("y_pred"), F.greatest(*final).alias("confidence"), *[p.alias(n) for p, n in zip(final, names)],
            probs.arg_max(raw, labels).alias("y_pred_raw"), *[p.alias(f"prob_raw_{x}") for p, x in zip(raw, labels)]), "OK", ""))
    return out


def _changed(change, k: int):
    """Batches with the probabilities ``p`` of each slot changed; rows of slots without a map are left out."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, p = np.asarray(batch.column("_s")), np.asarray(batch.column("p").flatten()).reshape(-1, k)
            out, kept = np.zeros(p.shape), np.ones(len(p), bool)
            for s in np.unique(slot).tolist():
                m = slot == s
                new = change(s, p[m])
                kept[m] = new is not None
                if new is not None:
                    out[m] = new
            ends = pa.array(np.arange(0, out.size + 1, k).astype(np.int32))
            columns = [pa.ListArray.from_arrays(ends, pa.array(out.ravel())) if c == "p" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(kept))
    return run


def out_of_fold(rows: DataFrame, roles: DataFrame, features: FeatureSet, spec: RunSpec, labels: Sequence[str],
                group: str, label: str = "y_true") -> tuple[DataFrame | None, str, str]:
    """``out_of_fold_all`` of one run."""
    return out_of_fold_all(rows, roles, features, [spec], labels, group, label)[0]


def prediction_metrics(pred: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    cols = [f"prob_{x}" for x in labels]
    by_class = metrics.classification_scores(pred, keys, labels)
    by_prob = metrics.probability_scores(pred, keys, cols, labels)
    ece = metrics.expected_calibration_error(pred, keys, "confidence", F.col("y_true") == F.col("y_pred"))
    return by_class.join(by_prob, list(keys)).join(ece, list(keys))


GRID_METRICS = ["balanced_accuracy", "macro_f1", "log_loss", "brier", "ece"]


def compare_runs(rows: DataFrame, roles: DataFrame, features: FeatureSet, specs: Sequence[RunSpec],
                 labels: Sequence[str], group: str, label: str = "y_true") -> DataFrame:
    """One row per (model, calibration): status, reason and the mean metrics over seeds, raw and calibrated. A
    combination whose data do not allow its fit is reported; any other error is raised."""
    spark = rows.sparkSession
    states, tables, table = [], [], None
    by_model: dict = {}
    for spec in specs:
        by_model.setdefault((spec.model, spec.params), []).append(spec)
    for (model, params), group_of in by_model.items():
        try:
            if model in JOINT_MODELS:
                table = table or fold_models.fold_table(rows, roles, features.categorical, features.numeric, labels, group, label, _slots(roles))
            if model in JOINT_MODELS and _joint(table, model, labels):
                runs, sums = _joint_sums(table, model, dict(params), [spec.calibration for spec in group_of])
                tables += _summaries(spark, model, table, sums)
            else:
                runs = out_of_fold_all(rows, roles, features, group_of, labels, group, label, table)
                for spec, (pred, _, _) in zip(group_of, runs):
                    if pred is not None:
                        tables.append(_summary(pred, spec, labels))
        except (ValueError, IllegalArgumentException) as error:
            runs = [(None, "FAIL", f"{type(error).__name__}: {str(error)[:200]}")] * len(group_of)
        states += [(spec.model, spec.calibration, status, reason) for spec, (_, status, reason) in zip(group_of, runs)]
    frame = spark.createDataFrame(states, "model string, calibration string, status string, reason string")
    return frame.join(reduce(DataFrame.unionByName, tables), ["model", "calibration"], "left") if tables else frame


def _summary(pred: DataFrame, spec: RunSpec, labels: Sequence[str]) -> DataFrame:
    """Mean metrics of one run from its predictions, in one row."""
    pred = pred.persist(StorageLevel.MEMORY_AND_DISK)  # every metric reads it
    raw = pred.select("seed", "fold", "y_true", F.col("y_pred_raw").alias("y_pred"), *[
        F.col(f"prob_raw_{x}").alias(f"prob_{x}") for x in labels]).withColumn(
            "confidence", F.greatest(*[F.col(f"prob_{x}") for x in labels]))
    final = metrics.two_level_rollup(prediction_metrics(pred, ["seed", "fold"], labels), [], "seed", GRID_METRICS)
    before = metrics.two_level_rollup(prediction_metrics(raw, ["seed", "fold"], labels), [], "seed", GRID_METRICS)
    before = before.select(*[F.col(c).alias(f"raw_{c}") for c in before.columns])
    summary = final.join(F.broadcast(before)).select(  # one row each
        F.lit(spec.model).alias("model"), F.lit(spec.calibration).alias("calibration"), "*")
    kept = pred.sparkSession.createDataFrame(summary.collect(), summary.schema)  # one row
    pred.unpersist()
    return kept


def _joint_sums(ft: fold_models.FoldTable, model: str, params: dict, calibrations: Sequence[str]) -> tuple[list[tuple], dict[str, list[dict]]]:
    """State of every run, and for each that is fitted the sums of its test rows by slot, calibrated and raw."""
    joint = _JointFit.of(ft, model, params, calibrations)
    states, fitted = [], []
    for calibration in calibrations:
        reason = joint.isotonic_reason() if calibration == "isotonic" else None
        states.append((None, "SKIP", reason) if reason else (None, "OK", ""))
        if not reason:
            fitted.append(calibration)
    with_calib = [c == "none" for c in fitted]
    asked = sorted(set(with_calib))
    maps = [(w, joint.change(c)) for w, c in zip(with_calib, fitted)] + [(w, None) for w in asked]
    edges = np.array([i * (1.0 / CONFIDENCE_BINS) for i in range(CONFIDENCE_BINS)])
    n_bins = CONFIDENCE_BINS

    def bin_of(x: np.ndarray) -> np.ndarray:
        return np.where((x > 0.0) & (x <= 1.0), np.searchsorted(edges, x, side="left") - 1, n_bins)

    sums = fold_models.run_sums(ft, joint.fits, joint.prep, joint.fitted, maps, bin_of, n_bins, metrics.LOG_LOSS_EPS)
    of = lambda j: {slot: v for (run, slot), v in sums.items() if run == j}
    return states, {c: [of(j), of(len(fitted) + asked.index(w))] for j, (c, w) in enumerate(zip(fitted, with_calib))}


CONFIDENCE_BINS = 10


def _summaries(spark, model: str, ft: fold_models.FoldTable, sums: Mapping[str, Sequence[dict]]) -> list[DataFrame]:
    """``_summary`` of each run, from its sums."""
    labels, k, keys = ft.labels, len(ft.labels), ["calibration", "side", "seed", "fold"]
    conf, rest, bins = [], [], []
    for calibration, sides in sums.items():
        for side, by_slot in zip(("", "raw_"), sides):
            for slot, v in by_slot.items():
                key = (calibration, side, *ft.slots[slot])
                table, (loss, gap), binned = np.rint(v[:k * k]).reshape(k, k), v[k * k:k * k + 2], v[k * k + 2:].reshape(3, -1)
                binned[:2] = np.rint(binned[:2])      # sums of counts come back as doubles, a last bit off at times
                n = float(table.sum())
                conf += [(*key, labels[a], labels[b], int(table[a, b])) for a in range(k) for b in range(k) if table[a, b]]
                rest.append((*key, float(loss / n), float(gap / n)))
                bins += [(*key, j if j < binned.shape[1] - 1 else None, int(m), float(hits / m), float(c / m)) for j, (m, hits, c) in enumerate(binned.T) if m]
    if not rest:
        return []
    kind = "calibration string, side string, seed int, fold int"
    scores = metrics.scores_from_confusion(spark.createDataFrame(conf, f"{kind}, y_true string, y_pred string, n long"), keys, labels)
    scores = scores.join(spark.createDataFrame(rest, f"{kind}, log_loss double, brier double"), keys).join(
        metrics.calibration_error_of_bins(spark.createDataFrame(bins, f"{kind}, _bin int, _n long, _acc double, _conf double"), keys), keys)
    found = metrics.two_level_rollup(scores, keys[:2], "seed", GRID_METRICS)
    measures = found.columns[2:]
    rows = {(r["calibration"], r["side"]): [r[c] for c in measures] for r in found.collect()}      # two rows a run
    made = [(model, c, *rows[c, ""], *rows[c, "raw_"]) for c in sums if (c, "") in rows]
    schema = T.StructType([T.StructField("model", T.StringType(), False), T.StructField("calibration", T.StringType(), False),
                           *[T.StructField(f"{side}{m}", found.schema[m].dataType) for side in ("", "raw_") for m in measures]])
    return [spark.createDataFrame(made, schema)]


def default_run(comparison: DataFrame) -> DataFrame:
    """Best OK combination: balanced accuracy first, then log loss, then name."""
    return curves.pick_best(comparison.where(F.col("status") == "OK"), [], [
        F.col("balanced_accuracy_mean").desc_nulls_last(), F.col("log_loss_mean").asc_nulls_last(),
        F.col("model"), F.col("calibration")])


def compare_feature_sets(rows: DataFrame, roles: DataFrame, sets: Sequence[FeatureSet], spec: RunSpec,
                         labels: Sequence[str], group: str, label: str = "y_true") -> DataFrame:
    """Metrics per (feature set, seed), folds pooled."""
    out = None
    for features in sets:
        pred, status, reason = out_of_fold(rows, roles, features, spec, labels, group, label)
        if pred is None:
            raise ValueError(f"{features.name}: {status} {reason}")
        scored = prediction_metrics(pred, ["seed"], labels).withColumn("config", F.lit(features.name))
        out = scored if out is None else out.unionByName(scored)
    return out


def equal_configs(scores: DataFrame, first: str, second: str, metric: str = "balanced_accuracy",
                  tolerance: float = 1e-6) -> DataFrame:
    """Per seed: do two configurations agree on a metric within the tolerance?"""
    pick = lambda c, n: scores.where(F.col("config") == c).select("seed", F.col(metric).alias(n))
    return pick(first, "first_value").join(pick(second, "second_value"), "seed").withColumn(
        "equal", F.abs(F.col("first_value") - F.col("second_value")) <= tolerance)


def forest_baseline(rows: DataFrame, folds: DataFrame, features: FeatureSet, labels: Sequence[str], group: str,
                    label: str = "y_true", trees: int = 200) -> DataFrame:
    """Balanced accuracy per seed on the first fold that holds all classes."""
    chosen = F.broadcast(fold_ops.first_complete(rows, folds, group, label, labels, ["seed"], "fold").select(  # one row a seed
        "seed", F.col("fold").alias("_own")))
    roles = folds.join(chosen, "seed").select(group, "seed", F.col("_own").alias("fold"),
                                              F.when(F.col("fold") == F.col("_own"), "test").otherwise("train").alias("role"))
    pred, _, _ = out_of_fold(rows, roles, features, RunSpec("forest", "none", (("trees", trees),)), labels, group, label)
    return metrics.classification_scores(pred, ["seed", "fold"], labels)


# --- permutation importance ------------------------------------------------------------------

def shuffled_column(df: DataFrame, row_id: str, column: str, salt: str, **sizing) -> DataFrame:
    """(row_id, column) with the column's values dealt to other rows in md5 order, distributed."""
    work = df.select(row_id, column, F.md5(F.concat_ws(":", F.lit(salt), F.col(row_id).cast("string"))).alias("_h"))
    takes = ordering.row_positions(work, [], row_id, [], position="_at", total="_n", **sizing).select(row_id, "_at")
    gives = ordering.row_positions(work, [], "_h", [row_id], position="_at", total="_n", **sizing).select("_at", column)
    return takes.join(gives, "_at").select(row_id, column)


def permutation_importance(fitted: Classifier, prep: Preparation, test: DataFrame, columns: Sequence[str],
                           labels: Sequence[str], repeats: int = 5, label: str = "y_true", seed: int = 42,
                           **sizing) -> DataFrame:
    """Mean and deviation of the balanced-accuracy loss when one column is shuffled, most important first.

    All columns and repeats are dealt in one order, as ``shuffled_column`` deals one, and scored in one job.
    """
    columns = list(columns)
    used = list(dict.fromkeys(["row_id", label, *prep.fills, *prep.medians, *columns]))
    test = ordering.row_positions(test.select(*used), [], "row_id", [], position="_at", total="_n", **sizing).drop("_n")
    test = written(test.repartition(test.sparkSession.sparkContext.defaultParallelism * 4, "row_id"))
    # every column and repeat deals its own values to the rows by place, all in one order
    turns = F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.lit(r).alias("_repeat")) for c in columns for r in range(repeats)]))
    work = test.select("row_id", *columns, turns.alias("_t")).select("row_id", "_t.*", *[F.when(F.col("_t._column") == c, F.col(c)).alias(f"_g_{c}") for c in columns])
    work = work.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "_column", "_repeat", F.col("row_id").cast("string"))))
    # the first digits of a hash are even ranges of its order
    work = work.withColumn("_b", F.substring("_h", 1, math.ceil(math.log(max(test.count() / ROWS_PER_HASH_RANGE, 1), 16))))
    turn = ["_column", "_repeat"]
    before = Window.partitionBy(*turn).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = work.groupBy(*turn, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = sizes.select(*turn, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    gives = work.withColumn("_in", F.row_number().over(Window.partitionBy(*turn, "_b").orderBy("_h", "row_id"))).join(
        F.broadcast(earlier), [*turn, "_b"]).withColumn("_at", F.col("_before") + F.col("_in"))  # one row a turn and range
    gives = gives.select("_at", *turn, *[f"_g_{c}" for c in columns])
    mixed = gives.join(test, "_at").withColumns({c: F.when(F.col("_column") == c, F.col(f"_g_{c}")).otherwise(F.col(c)) for c in columns})
    whole = test.withColumns({"_column": F.lit(""), "_repeat": F.lit(0)})
    stacked = whole.unionByName(mixed.select(*whole.columns))
    pred = fitted.predict(prep.apply(stacked))
    pred = pred.withColumn("y_pred", probs.arg_max([F.col(f"prob_{x}") for x in labels], labels))
    scored = metrics.classification_scores(pred, ["_column", "_repeat"], labels, label, "y_pred")
    base = scored.where(F.col("_column") == "").select(F.col("balanced_accuracy").alias("_base"))
    drops = scored.where(F.col("_column") != "").join(F.broadcast(base)).withColumn(  # one row
        "drop", F.col("_base") - F.col("balanced_accuracy"))
    return drops.groupBy(F.col("_column").alias("column_name")).agg(
        F.avg("drop").alias("importance_mean"), F.coalesce(F.stddev_pop("drop"), F.lit(0.0)).alias("importance_std"))
