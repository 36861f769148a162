"""Penalised logits of many folds and settings at once.

Rows are written once, as numbers on one common scale and numbers of categories, ordered by date. One pass gathers, for
every fold and setting that is not solved yet, the loss, gradient and Hessian of the rows that train it; a row tells which
folds those are (an interval), so it isn't multiplied. What passes through the driver are those sums and the coefficients.
There each model takes a proximal Newton step (coordinate descent on the quadratic model where the penalty has corners),
halved when the loss has grown. A pass is one job however many folds and settings there are.

Gaps take the fold's median, numbers the fold's standard scores, categories a column each; all that is linear in the
common numbers, their gaps and the categories, so every fold is worked on in one design and its own scale is applied to
the sums (``Fold.map``). Medians are exact (medians.py). A category that no training row of a fold has is left out there.

The loss is sum of weight * log loss + (l1_ratio * |b| + (1 - l1_ratio) / 2 * b^2) / C, without a penalty on the
intercept; it is solved until no score equation is off by more than ``tol``.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import drop, store
from .medians import discard, medians
from .metrics import add_ranks, classification_metrics, score_columns
from .ml import LOGIT, combinations, cross_sectional_scale, model_inputs
from .targets import HORIZONS
from .temporal import Rolling

log = logging.getLogger(__name__)
#: Bytes of the Hessians that one pass gathers, at most; more models take more passes.
PASS_BYTES = 128 << 20


@dataclass
class Design:
    """Common numbers of a dataset: (value - centre) / scale, and the categories of each categorical column."""

    numeric: list[str]
    categories: list[str]
    centre: list[float]
    scale: list[float]
    labels: list[list[str]]

    @property
    def width(self) -> int:
        return 2 * len(self.numeric) + sum(map(len, self.labels)) + 1

    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}={v}" for c, own in zip(self.categories, self.labels) for v in own]]

    def columns(self) -> list:
        """xs: array of numbers, null for gaps; cs: array of category numbers, -1 for unknown ones."""
        xs = [(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) - m) / s for c, m, s in zip(self.numeric, self.centre, self.scale)]
        cs = [F.coalesce(F.array_position(F.array(*[F.lit(v) for v in own]), F.coalesce(F.col(c).cast("string"), F.lit("missing"))) - 1, F.lit(-1)).cast("int") if own else F.lit(-1) for c, own in zip(self.categories, self.labels)]
        return [F.array(*xs).cast("array<double>").alias("__xs"), F.array(*cs).cast("array<int>").alias("__cs")]

    def matrix(self, xs: pa.ListArray, cs: pa.ListArray) -> np.ndarray:
        n, k = len(xs), len(self.numeric)
        out = np.zeros((n, self.width))
        flat = xs.flatten().to_numpy(zero_copy_only=False).reshape(n, k) if k else np.zeros((n, 0))
        gap = np.isnan(flat)
        out[:, :k], out[:, k : 2 * k] = np.where(gap, 0.0, flat), gap
        at = 2 * k
        codes = cs.flatten().to_numpy(zero_copy_only=False).reshape(n, len(self.labels)) if self.labels else None
        for i, own in enumerate(self.labels):
            known = np.flatnonzero(codes[:, i] >= 0)
            out[known, at + codes[known, i]] = 1.0
            at += len(own)
        out[:, -1] = 1.0
        return out


def design_of(df: DataFrame, with_active: bool = False, with_asset: bool = False) -> Design:
    numeric, categories = model_inputs(df, with_active, with_asset)
    x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric]
    row = df.agg(F.lit(0), *[f(v).alias(f"{n}{i}") for i, v in enumerate(x) for n, f in (("m", F.avg), ("s", F.stddev_pop))], *[F.sort_array(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("missing")))).alias(f"l{i}") for i, c in enumerate(categories)]).first()
    return Design(numeric, categories, [row[f"m{i}"] or 0.0 for i in range(len(x))], [row[f"s{i}"] or 1.0 for i in range(len(x))], [list(row[f"l{i}"]) for i in range(len(categories))])


@dataclass
class Fold:
    """What the training rows of a fold tell of its scale: medians and moments of the common numbers, rows of each class and category."""

    n: np.ndarray
    map: np.ndarray
    present: np.ndarray
    shown: np.ndarray


@dataclass
class Fitted:
    fold: int
    setting: int
    weights: tuple[float, float]
    beta: np.ndarray
    loss: float = np.inf
    before: np.ndarray | None = None
    before_loss: float = np.inf
    gradient: np.ndarray | None = None
    off: float = np.inf
    passes: int = 0
    done: bool = False


@dataclass
class Fits:
    design: Design
    settings: list[dict]
    folds: dict[int, Fold]
    models: list[Fitted] = field(default_factory=list)
    errors: dict = field(default_factory=dict)

    def coefficients(self) -> list[tuple]:
        """(fold, setting, feature, coefficient), and the intercept under "intercept"; features without a column in a fold are left out."""
        names = np.array([*self.design.names(), "intercept"])
        return [(m.fold, m.setting, str(f), float(b)) for m in self.models for f, b in zip(names[self.folds[m.fold].shown], m.beta)]

    def score_rows(self) -> list[tuple]:
        """(fold, setting, feature, score): the sum of weighted feature values that each score equation makes the fitted probabilities have.

        At the solution it is the sum over the rows with target 1. It comes from the probabilities, the penalty's slope and,
        where a coefficient is zero, the slope between -l1 and l1 that fits best.
        """
        names, out = np.array([*self.design.names(), "intercept"]), []
        for m in self.models:
            fold, (l1, l2) = self.folds[m.fold], penalties(self.settings[m.setting])
            free = np.arange(len(m.beta)) == len(m.beta) - 1
            slope = np.where(m.beta != 0, np.sign(m.beta), np.clip(-m.gradient / l1, -1, 1) if l1 else 0.0)
            told = m.gradient + np.where(free, 0.0, l2 * m.beta + l1 * slope)  # zero at the solution
            hits = fold.map.T @ (fold.n[2:] * m.weights[1])
            out += [(m.fold, m.setting, str(f), float(x)) for f, x in zip(names[fold.shown], told + hits)]
        return out

    def scored(self, rows: DataFrame, setting: int = 0, fold: str = "fold_id") -> DataFrame:
        """rows (which have a fold each) with pred_proba_success, pred_class and pred_log_odds; rows of folds without a model are left out."""
        known = {m.fold: self.folds[m.fold].map @ m.beta for m in self.models if m.setting == setting}
        design, columns = self.design, rows.columns
        ready = rows.where(F.col(fold).isin(*known)).select("*", *design.columns(), F.col(fold).cast("int").alias("__k"))

        def score(batches):
            for batch in batches:
                x, k = design.matrix(batch.column(len(columns)), batch.column(len(columns) + 1)), batch.column(len(columns) + 2).to_numpy()
                p = np.empty(len(k))
                for own in np.unique(k):
                    p[k == own] = chance(x[k == own] @ known[own])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(p)], [*columns, "pred_proba_success"])

        schema = rows.withColumn("pred_proba_success", F.lit(0.0)).schema
        return score_columns(ready.mapInArrow(score, schema))


def chance(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def penalties(s: dict) -> tuple[float, float]:
    """Strengths of |b| and b^2 / 2."""
    share = {"l1": 1.0, "l2": 0.0, "elasticnet": s["l1_ratio"]}[s["penalty"]]
    return share / s["C"], (1 - share) / s["C"]


def gathered(rows: DataFrame, design: Design, size: int, work) -> dict[int, np.ndarray]:
    """Sums over rows (__lo, __hi, __y, __xs, __cs): work(fold, matrix, targets) gives {key: vector of that size or a matrix as one} for the rows of a fold. One job."""

    def part(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lo, hi, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(lo):
                continue
            x = design.matrix(batch.column(3), batch.column(4))
            for k in range(int(lo.min()), int(hi.max()) + 1):
                own = (lo <= k) & (k <= hi)
                if own.any():
                    for key, value in work(k, x[own], y[own]).items():
                        sums[key] = sums[key] + value if key in sums else value
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["key", "sums"])

    def whole(batches):
        key, held = None, None
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["key", "sums"])
                    key, held = k, np.zeros(size)
                held = held + np.frombuffer(v)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["key", "sums"])

    kind = "key long, sums binary"
    summed = rows.select("__lo", "__hi", "__y", "__xs", "__cs").mapInArrow(part, kind).repartition("key").sortWithinPartitions("key").mapInArrow(whole, kind)
    return {r.key: np.frombuffer(bytes(r.sums)) for r in summed.collect()}  # a row a model


def fold_scales(rows: DataFrame, design: Design, scaling: str) -> dict[int, Fold]:
    """Scales of all folds: exact medians of their rows, then one pass of moments."""
    k, width = len(design.numeric), design.width
    each = rows.select(F.explode(F.sequence("__lo", "__hi")).alias("fold"), *[F.col("__xs")[i].alias(f"x{i}") for i in range(k)])
    middle = {}
    if k:
        made = medians(each, [f"x{i}" for i in range(k)], ["fold"])
        for r in made.collect():  # folds x columns
            middle.setdefault(r.fold, np.zeros(k))[int(r["column"][1:])] = r["median"] or 0.0
        discard(made)
    sums = gathered(rows, design, 2 * width + 1 + k, lambda _, x, y: {_: np.concatenate([[len(y)], x.sum(0), y @ x, (x[:, :k] ** 2).sum(0)])})
    out = {}
    for fold, s in sums.items():
        n, total, hits, squares = s[0], s[1 : 1 + width], s[1 + width : 1 + 2 * width], s[1 + 2 * width :]
        m = middle.get(fold, np.zeros(k))
        gaps = total[k : 2 * k]
        mean = (total[:k] + gaps * m) / n
        spread = np.sqrt(np.maximum((squares + gaps * m * m) / n - mean**2, 0.0))
        if scaling == "classical":
            spread = np.where(spread > 1e-12 * (1 + np.abs(mean)), spread, 1.0)
        else:  # as they come: off the common scale again
            mean, spread = -np.array(design.centre) / np.array(design.scale), 1 / np.array(design.scale)
        cats = np.flatnonzero(total[2 * k : -1] > 0)
        t = np.zeros((width, k + len(cats) + 1))
        j = np.arange(k)
        t[j, j], t[k + j, j], t[-1, j] = 1 / spread, m / spread, -mean / spread
        t[2 * k + cats, k + np.arange(len(cats))] = 1.0
        t[-1, -1] = 1.0
        shown = np.concatenate([j, k + cats, [k + width - 2 * k - 1]]).astype(int)
        out[fold] = Fold(np.concatenate([[n, hits[-1]], hits]), t, cats, shown)
    return out


def newton_step(beta: np.ndarray, g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The minimum of the quadratic model with the penalty."""
    d, free = len(beta), len(beta) - 1
    ridge = np.full(d, l2)
    ridge[free] = 0.0
    full = h + np.diag(ridge + 1e-10 * (1 + np.trace(h) / d))
    if not l1:
        return beta - np.linalg.solve(full, g + ridge * beta)
    new, slope = beta.copy(), g + ridge * beta  # slope of the smooth part at new
    diagonal = np.diag(full).copy()
    for _ in range(2000):
        most = 0.0
        for j in range(d):
            at = new[j] - slope[j] / diagonal[j]
            to = at if j == free else np.sign(at) * max(abs(at) - l1 / diagonal[j], 0.0)
            if to != new[j]:
                slope += full[:, j] * (to - new[j])
                most = max(most, abs(to - new[j]) * np.sqrt(diagonal[j]))
                new[j] = to
        if most < 1e-11 * (1 + np.sqrt(diagonal.max())):
            break
    return new


def off_by(beta: np.ndarray, g: np.ndarray, l1: float, l2: float) -> float:
    """How far the score equations are from being met."""
    smooth = g + np.where(np.arange(len(beta)) == len(beta) - 1, 0.0, l2 * beta)
    inner = np.where(beta != 0, np.abs(smooth + l1 * np.sign(beta)), np.maximum(np.abs(smooth) - l1, 0.0))
    inner[-1] = abs(smooth[-1])
    return float(inner.max())


def penalty(beta: np.ndarray, l1: float, l2: float) -> float:
    return float(l1 * np.abs(beta[:-1]).sum() + l2 / 2 * (beta[:-1] ** 2).sum())


def solve(rows: DataFrame, fits: Fits, tol: float, most: int) -> None:
    """Passes until every model is solved or has taken most of them; those are told as errors."""
    design, width = fits.design, fits.design.width
    size = 1 + width + width * width
    room = max(1, PASS_BYTES // (8 * size))
    while open_ := [m for m in fits.models if not m.done]:
        for at in range(0, len(open_), room):
            some = open_[at : at + room]
            asked: dict[int, list] = {}
            for m in some:
                asked.setdefault(m.fold, []).append((fits.models.index(m), fits.folds[m.fold].map @ m.beta, m.weights))

            def work(fold, x, y, asked=asked):
                out = {}
                for key, gamma, (w0, w1) in asked.get(fold, ()):
                    eta, w = x @ gamma, np.where(y > 0, w1, w0)
                    p = chance(eta)
                    loss = (w * (np.logaddexp(0.0, eta) - y * eta)).sum()
                    out[key] = np.concatenate([[loss], (w * (p - y)) @ x, (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()])
                return out

            sums = gathered(rows, design, size, work)
            for key, s in sums.items():
                advance(fits.models[key], s, fits, width, tol, most)


def advance(m: Fitted, s: np.ndarray, fits: Fits, width: int, tol: float, most: int) -> None:
    t, (l1, l2) = fits.folds[m.fold].map, penalties(fits.settings[m.setting])
    loss, g, h = s[0] + penalty(m.beta, l1, l2), t.T @ s[1 : 1 + width], t.T @ s[1 + width :].reshape(width, width) @ t
    m.passes += 1
    if m.before is not None and loss > m.before_loss + 1e-9 * (1 + abs(m.before_loss)) and m.passes < most:
        m.beta = (m.beta + m.before) / 2
        return
    m.loss, m.gradient, m.off = loss, g, off_by(m.beta, g, l1, l2)
    if m.off <= tol:
        m.done = True
    elif m.passes >= most:
        m.done = True
        fits.errors[m.fold, m.setting] = f"score equations off by {m.off:.3g} after {m.passes} passes"
        log.warning("fold %s, setting %s: %s", m.fold, m.setting, fits.errors[m.fold, m.setting])
    else:
        m.before, m.before_loss = m.beta, loss
        m.beta = newton_step(m.beta, g, h, l1, l2)


def fit_batched(df: DataFrame, settings: list[dict], lo="__lo", hi="__hi", tol: float = 1e-7, passes: int = 60) -> Fits:
    """Logits of all folds and settings. df has the first and last fold that a row trains (null: none), and a target, 0 or 1.

    Settings differ in penalty, C, l1_ratio and class_weight; scaling, with_active and with_asset are the same for all.
    Folds with one class are told as errors.
    """
    settings = [LOGIT | s for s in settings]
    kind = {(s["scaling"], bool(s.get("with_active")), bool(s.get("with_asset"))) for s in settings}
    if len(kind) != 1:
        raise ValueError("settings of one batch share their scaling and inputs")
    scaling, with_active, with_asset = kind.pop()
    if bad := df.where(F.col("target").isNotNull() & ~F.col("target").isin(0.0, 1.0)).limit(1).collect():
        raise ValueError(f"the target needs the classes 0 and 1, not {bad[0].target}")
    own = df.where(F.col(lo).isNotNull() & (F.col(lo) <= F.col(hi)) & F.col("target").isNotNull())
    own = own.withColumns({"__a": F.col(lo).cast("int"), "__b": F.col(hi).cast("int")})
    design = design_of(own, with_active, with_asset)
    ordered = own.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__a", "__b", "date")
    rows = store(ordered.select(F.col("__a").alias("__lo"), F.col("__b").alias("__hi"), F.col("target").cast("double").alias("__y"), *design.columns()), "design")
    fits = Fits(design, settings, fold_scales(rows, design, scaling))
    for k, fold in sorted(fits.folds.items()):
        n, hits = fold.n[:2]
        for i, s in enumerate(settings):
            if hits in (0, n):
                fits.errors[k, i] = "the target needs the classes 0 and 1"
                continue
            w = (n / (2 * (n - hits)), n / (2 * hits)) if s["class_weight"] == "balanced" else tuple(float((s["class_weight"] or {}).get(c, 1.0)) for c in (0, 1))
            fits.models.append(Fitted(k, i, w, np.zeros(fold.map.shape[1])))
    solve(rows, fits, tol, passes)
    drop(rows)
    return fits


def backtest_batched(dataset: DataFrame, splitter: Rolling = Rolling(), horizons=HORIZONS, dates: DataFrame | None = None, **setting) -> dict:
    """What rolling_backtest gives for a logit (the default penalty is that of logit_backtest), with jobs that don't grow with the folds. dates: a calendar from elsewhere."""
    setting = {"penalty": "l2", "C": 0.05} | setting
    if setting.get("scaling") == "cross_sectional":
        numeric = model_inputs(dataset, setting.get("with_active", False))[0]
        raw = dataset.withColumns({f"__raw_{c}": F.col(c) for c in numeric})
        spans = splitter.train_spans(cross_sectional_scale(raw, numeric), horizons, dates=dates)
    else:
        spans = splitter.train_spans(dataset, horizons, dates=dates)
    fits = fit_batched(spans, [setting])
    if not fits.models:
        raise ValueError(f"no fold could be fitted: {fits.errors}")
    assigned = splitter.assign(spans.drop("__lo", "__hi"), horizons, dates=dates)
    told = splitter.summary(assigned).withColumns({"period_train": F.lit(splitter.train), "period_test": F.lit(splitter.test), "period_embargo": F.lit(splitter.embargo)})
    folds = store(told, "folds")
    oos = fits.scored(assigned.where("block = 'test'").drop("block"))
    if setting.get("scaling") == "cross_sectional":
        oos = oos.withColumns({c: F.col(f"__raw_{c}") for c in numeric}).drop(*[f"__raw_{c}" for c in numeric])
    oos = oos.withColumns({"y_true": F.col("target"), "y_pred": F.col("pred_class"), "y_proba_pred": F.col("pred_proba_success")}).join(F.broadcast(folds), "fold_id")
    oos = store(add_ranks(oos, ["date", "asset", "horizon"]), "oos")
    return {"oos": oos, "folds": folds, "fold_metrics": classification_metrics(oos, ["fold_id"]), "metrics": classification_metrics(oos), "errors": {k: e for (k, _), e in fits.errors.items()}, "fits": fits, "release": lambda: drop(folds, oos)}


def grid_batched(train: DataFrame, validation: DataFrame, options: dict[str, list], fixed: dict | None = None) -> DataFrame:
    """What ml.grid gives for logits, all settings fitted in the same passes."""
    spark, chosen, good = train.sparkSession, combinations(options), []
    told = ("n_obs", "target_rate", "accuracy", "f1", "roc_auc", "log_loss", "brier_score")
    names, problems = list(options), {}
    kinds = {k: "double" if all(v is None or isinstance(v, (int, float)) for v in options[k]) else "string" for k in names}
    for i, c in enumerate(chosen):
        setting = LOGIT | (fixed or {}) | {k: v for k, v in c.items() if v is not None}
        if setting["penalty"] in ("l1", "l2", "elasticnet") and setting["C"] > 0:
            good.append((i, setting))
        else:
            problems[i] = f"no penalty {setting['penalty']} with C {setting['C']}"
    fits = fit_batched(train.withColumns({"__lo": F.lit(0), "__hi": F.lit(0)}), [s for _, s in good]) if good else None
    n, rate = train.where("target IS NOT NULL").agg(F.count(F.lit(1)), F.avg("target")).first()
    every, made = [], {}
    for at, (i, _) in enumerate(good):
        if (0, at) in fits.errors:
            problems[i] = fits.errors[0, at]
        else:
            every.append(fits.scored(validation.withColumn("fold_id", F.lit(0)), at).select(F.lit(i).alias("setting"), "target", "pred_proba_success"))
    if every:
        whole = every[0]
        for e in every[1:]:
            whole = whole.unionByName(e)
        made = {r.setting: [r[c] for c in told] for r in classification_metrics(whole, ["setting"]).collect()}  # a row a setting
    rows = []
    for i, c in enumerate(chosen):
        own = [None if (v := c[k]) is None else float(v) if kinds[k] == "double" else str(v) for k in names]
        rows.append((*own, i not in problems, problems.get(i), n, rate, *made.get(i, [None] * len(told))))
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in names], "fit_ok boolean, error string, n_train_obs long, target_rate_train double, n_obs long", *[f"{c} double" for c in told[1:]]])
    return spark.createDataFrame(rows, schema).orderBy(F.desc("fit_ok"), F.asc_nulls_last("log_loss"), F.asc_nulls_last("brier_score"), F.desc_nulls_last("roc_auc"))
