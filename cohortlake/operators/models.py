"""Model families, nested cross-validation, final fit and persistence.

* ``lightgbm`` -> boosted trees (120 rounds, step 0.08, depth 6 ~ 63 leaves) with balanced class weights;
* ``xgboost``  -> boosted trees (120 rounds, step 0.08, depth 6, 0.9 row and feature subsampling);
* ``tabnet``   -> ``StandardScaler`` + ``MultilayerPerceptronClassifier`` (a documented substitution).

The tree families' fits go through ``boosting.train``: all folds and grid
points of a run grow together, and grid points that differ in the number of
rounds alone are prefixes of one fit.  Data never leaves Spark: folds are
columns, out-of-fold predictions are a table.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting as B
from . import evaluate as V
from . import parallel
from . import sampling as S
from ..session import checkpoint_root, stored
from .boosted_model import BoostedTreesModel
from .prep import preprocessing_stages, probability_of_positive

# --- fixed values: families and their settings ----------------------------------
ALGORITHMS = ("lightgbm", "xgboost", "tabnet")
TREES = 120
GRIDS = {"lightgbm": {"maxDepth": (5, 6), "stepSize": (0.03, 0.05), "maxIter": (250, 400)},
         "xgboost": {"maxDepth": (4, 6), "stepSize": (0.03, 0.05), "maxIter": (250, 400)}}
TABNET_EPOCHS = {"response": 50, "mortality": 35}
TABNET_BATCH = {"response": 512, "mortality": 8192}
# --- end of fixed values --------------------------------------------------------


def network(seed: int = 42, task: str = "mortality", n_inputs: int | None = None, label: str = "label"):
    """H3: the neural family's estimator on column ``features_scaled``."""
    if n_inputs is None:
        raise ValueError("tabnet needs the encoded width")
    return MultilayerPerceptronClassifier(featuresCol="features_scaled", labelCol=label, layers=[n_inputs, 32, 16, 2], maxIter=TABNET_EPOCHS.get(task, 35),
                                          blockSize=TABNET_BATCH.get(task, 512), seed=seed)


def base_point(algorithm: str, trees: int = TREES) -> dict:
    """H1, H2: the family's base parameters."""
    if algorithm not in ALGORITHMS:
        raise ValueError("algorithm must be lightgbm, xgboost, or tabnet")
    return {"maxDepth": 6, "stepSize": 0.08, "maxIter": trees}


def boosted_fit(algorithm: str, key: str, part: str, point: dict, seed: int = 42, stages: Sequence[int] = ()) -> B.Fit:
    """A family's fit at one parameter point on one part."""
    share = {"xgboost": 0.9}.get(algorithm, 1.0)
    return B.Fit(key, part, point["maxIter"], point["maxDepth"], point["stepSize"], rows=share, columns=share, seed=seed, stages=tuple(stages))


def param_grid(algorithm: str, grid: dict | None = None) -> list[dict]:
    """H4: all points of the family's grid (or of ``grid``), over the base parameters; none for the neural family."""
    values = GRIDS.get(algorithm, {}) if grid is None else grid
    if algorithm not in GRIDS or not values:
        return []
    return [base_point(algorithm) | dict(zip(values, c)) for c in itertools.product(*values.values())]


@dataclass
class RunConfig:
    task: str
    algorithm: str
    label: str
    numeric: Sequence[str]
    categorical: Sequence[str]
    id_col: str = "row_id"
    seed: int = 42
    max_rows: int | None = None
    use_grid: bool = True
    final_params: str = "base"  # 'base' reproduces the reference; 'best' refits the tuned parameters
    oversample: bool = True     # SMOTE-style oversampling of every training fold, inner ones too
    trees: int = TREES          # boosting rounds of the tree families' base parameters
    grid: dict | None = None    # another grid than the family's own
    threads: int = parallel.THREADS  # folds prepared at once
    notes: list = field(default_factory=list)


def preprocessing(train: DataFrame, cfg: RunConfig) -> PipelineModel:
    return Pipeline(stages=preprocessing_stages(cfg.numeric, cfg.categorical)).fit(train)


def _encoded(train: DataFrame, cfg: RunConfig, prep_model) -> DataFrame:
    """Training rows as the learner gets them: encoded, then oversampled, then weighted."""
    enc = prep_model.transform(train).select(F.col(cfg.id_col).cast("string").alias("id"), "features", "label")
    if cfg.oversample:
        enc = oversample_encoded(enc, "id", cfg.seed)  # after encoding, training rows only
    if cfg.algorithm == "lightgbm":
        return S.with_class_weight(enc, "label", "weight").select("id", "features", "label", "weight")
    return enc.select("id", "features", "label", F.lit(1.0).alias("weight"))


def encoded_part(name: str, train: DataFrame, held: DataFrame, cfg: RunConfig) -> tuple[PipelineModel, DataFrame]:
    """Preprocessing fitted on ``train``, and the part's rows for ``boosting.train``; rows held out are only encoded (weight 0)."""
    prep_model = preprocessing(train, cfg)
    out = prep_model.transform(held).select(F.col(cfg.id_col).cast("string").alias("id"), "features", "label", F.lit(0.0).alias("weight"))
    rows = _encoded(train, cfg, prep_model).unionByName(out)
    return prep_model, rows.select(F.lit(name).alias("part"), "id", vector_to_array("features").alias("features"), F.col("label").alias("y"), "weight").checkpoint()


def _parts(spark, splits: dict[str, tuple[DataFrame, DataFrame]], cfg: RunConfig) -> tuple[dict, DataFrame]:
    """All parts encoded, several at once; preprocessing by part, and their rows together."""
    made = parallel.results(parallel.run_all(spark, {n: (lambda n=n, s=s: encoded_part(n, *s, cfg)) for n, s in splits.items()}, cfg.threads))
    rows = None
    for _, r in made.values():
        rows = r if rows is None else rows.unionByName(r)
    return {n: m for n, (m, _) in made.items()}, rows


def grid_search(splits: dict[str, dict[str, tuple[DataFrame, DataFrame]]], cfg: RunConfig, points: list[dict]) -> dict[str, tuple[dict, list[float]]]:
    """H4: for each of several searches, the point of best mean area under the curve over its inner folds, and all means.

    ``splits`` has, by search, the inner folds' (training, left out) rows.
    Points that differ in ``maxIter`` alone are read off one fit.  All fits of
    all searches grow together; one aggregate gives every area.
    """
    spark = next(iter(next(iter(splits.values())).values()))[0].sparkSession
    _, rows = _parts(spark, {f"{s}/{f}": pair for s, folds in splits.items() for f, pair in folds.items()}, cfg)
    shapes = sorted({(p["maxDepth"], p["stepSize"]) for p in points})
    rounds = sorted({p["maxIter"] for p in points})
    fits = [boosted_fit(cfg.algorithm, f"{s}/{f}/{d}/{st}", f"{s}/{f}", {"maxDepth": d, "stepSize": st, "maxIter": rounds[-1]}, cfg.seed, rounds)
            for s, folds in splits.items() for f in folds for d, st in shapes]
    _, scores = B.train(rows, fits)
    auc = {(r.key, r.rounds): r.auc for r in V.roc_auc(scores, groups=["key", "rounds"]).collect()}  # searches x folds x points
    out = {}
    for s, folds in splits.items():
        means = []
        for p in points:
            found = [auc.get((f"{s}/{f}/{p['maxDepth']}/{p['stepSize']}", p["maxIter"])) for f in folds]
            found = [a for a in found if a is not None]  # a fold with one class alone has none
            means.append(sum(found) / len(found) if found else 0.0)
        out[s] = points[means.index(max(means))], means
    return out


def _note(best: dict, means: list[float]) -> str:
    return "grid=" + ", ".join(f"{k}:{v}" for k, v in best.items()) + f"; inner_auc={max(means):.6f}"


def fit_network(train: DataFrame, cfg: RunConfig) -> PipelineModel:
    """H3: preprocessing, scaling and the network on ``train`` (label column ``label`` as double)."""
    prep_model = preprocessing(train, cfg)
    enc = _encoded(train, cfg, prep_model).checkpoint()  # the iterative learner's many jobs get short plans
    width = len(enc.select("features").first()[0])  # one row sizes the input layer
    scaler = StandardScaler(inputCol="features", outputCol="features_scaled", withMean=True).fit(enc)
    net = network(cfg.seed, cfg.task, width).fit(scaler.transform(enc))
    return PipelineModel(stages=prep_model.stages + [scaler, net])


def oversample_encoded(enc: DataFrame, id_col: str, seed: int) -> DataFrame:
    """F6 on the encoded training rows: synthetic minority vectors until the classes balance."""
    from .oversample import smote
    arr = enc.select(F.col(id_col).alias("_id"), vector_to_array("features").alias("_v"), "label")
    out = smote(arr, "_id", "_v", "label", seed=seed)
    return out.select(F.col("_id").alias(id_col), array_to_vector("_v").alias("features"), "label")


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, probability_of_positive().alias("p"))


def _used(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """The columns that a run reads, and ``label``: the task's label as a double."""
    cols = dict.fromkeys([cfg.id_col, *cfg.numeric, *cfg.categorical, cfg.label])
    return df.select(*cols).withColumn("label", F.col(cfg.label).cast("double"))


def nested_cv(df: DataFrame, cfg: RunConfig) -> dict:
    """H5: outer stratified K=3 folds; per fold fit (optionally inner-CV grid search) and score held-out rows.

    Returns the out-of-fold prediction table, per-fold metrics, the run's
    summary row and notes.  What runs depends on ``cfg`` alone; ``max_rows``
    bounds the rows of a run where a caller wants that.
    """
    spark = df.sparkSession
    checkpoint_root(spark)  # lineage cuts go to the shared checkpoint folder
    base_point(cfg.algorithm)
    data = S.stratified_cap(df, cfg.label, cfg.id_col, cfg.max_rows, cfg.seed)
    data = stored(_used(data, cfg), "run-rows")  # ranks and counts read it several times
    folds = S.stratified_folds(data, "label", cfg.id_col, S.OUTER_FOLDS, cfg.seed).checkpoint()
    n = folds.count()
    points = param_grid(cfg.algorithm, cfg.grid) if cfg.use_grid else []
    cfg.notes.append(f"gridsearch={str(bool(points)).lower()}")
    cfg.notes.append(f"oversampling={str(cfg.oversample).lower()}")
    outer = {str(f): (folds.filter(F.col("fold") != f), folds.filter(F.col("fold") == f)) for f in range(S.OUTER_FOLDS)}
    if cfg.algorithm == "tabnet":
        label = F.col("label").cast("int").alias("y")
        made = parallel.results(parallel.run_all(spark, {f: (lambda s=s: fit_network(s[0], cfg)) for f, s in outer.items()}, cfg.threads))
        # scored in one plan: a union of checkpointed folds fails, as their noted constraints name columns that they no longer have
        oof = None
        for f, (_, held) in outer.items():
            scored = score(made[f], held, [cfg.id_col, "fold", label])
            oof = scored if oof is None else oof.unionByName(scored)
    else:
        best = {f: base_point(cfg.algorithm, cfg.trees) for f in outer}
        if points:
            inner = S.inner_folds(folds, "label", cfg.id_col, seed=cfg.seed).checkpoint()
            searches = {f: {str(i): (inner.filter((F.col("outer_fold") == int(f)) & (F.col("inner_fold") != i)), inner.filter((F.col("outer_fold") == int(f)) & (F.col("inner_fold") == i)))
                            for i in range(S.INNER_FOLDS)} for f in outer}
            for f, (point, means) in grid_search(searches, cfg, points).items():
                best[f] = point
                cfg.notes.append(_note(point, means))
        _, rows = _parts(spark, outer, cfg)
        _, scores = B.train(rows, [boosted_fit(cfg.algorithm, f, f, p, cfg.seed) for f, p in best.items()])
        oof = scores.select(F.col("id").cast(df.schema[cfg.id_col].dataType).alias(cfg.id_col), F.col("key").cast("int").alias("fold"), "y", "p")
    oof = oof.checkpoint()
    fm = V.evaluate(oof, groups=["fold"])
    return {"oof": oof, "fold_metrics": fm, "n_rows": n, "notes": list(cfg.notes)}


def final_fit(df: DataFrame, cfg: RunConfig) -> dict:
    """H7: fit on the stratified 80 % split, score the 20 % holdout.

    ``final_params='base'`` (default) fits the family's base parameters, as the
    reference does; ``'best'`` refits the grid's best parameters.

    Also returns the holdout metrics, the best-F1 threshold (I6) and the
    split-conformal quantile (I11) of the holdout scores.
    """
    from .uncertainty import conformal_quantile
    spark = df.sparkSession
    checkpoint_root(spark)
    point = base_point(cfg.algorithm, cfg.trees)
    data = S.stratified_cap(df, cfg.label, cfg.id_col, cfg.max_rows, cfg.seed)
    data = stored(_used(data, cfg), "run-rows")  # ranks and counts read it several times
    split = S.holdout_split(data, "label", cfg.id_col, seed=cfg.seed).checkpoint()
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    ensemble = None
    if cfg.algorithm == "tabnet":
        model = fit_network(train, cfg)
    else:
        points = param_grid(cfg.algorithm, cfg.grid) if cfg.use_grid and cfg.final_params == "best" else []
        if points:  # inner stratified folds on the training split
            inner = S.stratified_folds(train, "label", cfg.id_col, S.INNER_FOLDS, f"{cfg.seed}:final", "inner_fold").checkpoint()
            found = grid_search({"final": {str(i): (inner.filter(F.col("inner_fold") != i), inner.filter(F.col("inner_fold") == i)) for i in range(S.INNER_FOLDS)}}, cfg, points)
            point = found["final"][0]
            cfg.notes.append(_note(*found["final"]))
        prep_model, rows = encoded_part("final", train, test, cfg)
        ensembles, _ = B.train(rows, [boosted_fit(cfg.algorithm, "final", "final", point, cfg.seed)])
        ensemble = ensembles["final"]
        model = PipelineModel(stages=prep_model.stages + [BoostedTreesModel.of(spark, ensemble)])
    cal = score(model, test, [cfg.id_col, F.col("label").cast("int").alias("y")]).checkpoint()
    return {"model": model, "ensemble": ensemble, "holdout": cal, "metrics": V.evaluate(cal), "best_threshold": V.best_threshold(cal),
            "conformal": conformal_quantile(cal)}


def save_model(model: PipelineModel, path: str) -> str:
    """Persist a fitted pipeline."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str, strict: bool = False) -> PipelineModel | None:
    """Load a fitted pipeline; a missing or unreadable model gives None unless ``strict``."""
    try:
        return PipelineModel.load(path)
    except Exception:
        if strict:
            raise
        return None


class PipelineScorer:
    """Adapter so a fitted pipeline can be used by ``serve.score_batch``."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        cols = df.columns
        return self.model.transform(df).select(*cols, probability_of_positive().alias(out))
