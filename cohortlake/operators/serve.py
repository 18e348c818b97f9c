"""Model selection and scoring.

Selection works on the ``runs`` table (one row per task x algorithm, a few
rows), scoring is one vectorised projection per task over the batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import FEATURE_ORDER
from ..functions.text import coerce_feature_types, normalize_payload

# --- fixed values -------------------------------------------------------------
ALGORITHMS = ("lightgbm", "xgboost", "tabnet")
DEFAULT_THRESHOLD = 0.5
DEFAULT_DRUG = "Cisplatin"
DROPPED_NOTE_PREFIX = "dropped_features="
RESPONSE_POSITIVE, RESPONSE_NEGATIVE = "Positive response expected", "Negative response expected"
MORTALITY_HIGH, MORTALITY_LOW = "Higher mortality risk", "Lower mortality risk"
NOT_TRAINED = "Model not trained"
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.8, 0.7
READY_MODE = "tree-stack split models (lightgbm/xgboost/tabnet + conformal)"
UNAVAILABLE_MODE = "unavailable"
INDEPENDENT_MESSAGE = "Response and mortality are predicted independently to avoid cross-task interference."
TOP_EXTRA_FEATURES = 5
# --- end of fixed values --------------------------------------------------------

def _catalog() -> Column:
    return F.array(*[F.lit(n) for n in FEATURE_ORDER])


def report_features(runs: DataFrame, notes: str = "notes") -> DataFrame:
    """Dropped features from the last 'dropped_features=' note; used = catalog order minus dropped."""
    note = F.try_element_at(F.filter(F.col(notes), lambda s: s.startswith(DROPPED_NOTE_PREFIX)), F.lit(-1))
    return runs.withColumn("_note", note).withColumn(
        "dropped_features",
        F.when(F.col("_note").isNull(), F.array().cast("array<string>")).otherwise(
            F.filter(F.split(F.regexp_replace(F.col("_note"), f"^{DROPPED_NOTE_PREFIX}", ""), ","),
                     lambda s: s != ""))).withColumn(
        "used_features", F.filter(_catalog(), lambda f: ~F.array_contains(F.col("dropped_features"), f))).drop("_note")


def rank_runs(runs: DataFrame) -> DataFrame:
    """Per task, AUC desc, Brier asc, then algorithm name desc; a missing report ranks last."""
    w = Window.partitionBy("task").orderBy(F.col("auc").desc_nulls_last(), F.col("brier").asc_nulls_last(),
                                           F.col("algorithm").desc())
    return runs.withColumn("rank", F.row_number().over(w))


def select_runs(ranked: DataFrame) -> DataFrame:
    """The first usable run (status 'ok') in rank order per task; reasons of skipped runs kept.

    Works on the ranked runs table (one row per task x algorithm).
    """
    ok = F.col("status") == "ok"
    first_ok = F.min(F.when(ok, F.col("rank"))).over(Window.partitionBy("task"))
    t = ranked.withColumn("_first_ok", first_ok)
    skipped = (t.filter((F.col("rank") < F.col("_first_ok")) | F.col("_first_ok").isNull())
               .groupBy("task").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(
                   ": ", "algorithm", F.coalesce("error", F.lit("model unavailable")))))).alias("_sk")))
    chosen = t.filter(F.col("rank") == F.col("_first_ok")).drop("_first_ok")
    tasks = ranked.select("task").distinct()
    return (tasks.join(chosen, "task", "left").join(skipped, "task", "left")
            .withColumn("skipped", F.coalesce(F.transform("_sk", lambda s: s.getField("col2")),
                                              F.array().cast("array<string>"))).drop("_sk"))


def decision_threshold(threshold: Column, default: float = DEFAULT_THRESHOLD) -> Column:
    """The report's threshold if inside [0, 1], else the default."""
    return F.when(threshold.between(0.0, 1.0), threshold).otherwise(F.lit(default))


def shared_features(response_used: Column, mortality_used: Column) -> Column:
    """Features used by both tasks in catalog order; all features if that is empty or unknown."""
    both = F.filter(_catalog(), lambda f: F.array_contains(response_used, f) & F.array_contains(mortality_used, f))
    usable = response_used.isNotNull() & mortality_used.isNotNull() & (F.size(both) > 0)
    return F.when(usable, both).otherwise(_catalog())


def top_extra_features(attribution: DataFrame, shared: Column, k: int = TOP_EXTRA_FEATURES) -> Column:
    """J6 input: the k features outside ``shared`` with the largest mean |attribution| (any task).

    ``attribution`` has (feature, mean_abs) rows, one per encoded feature
    and task (a catalog-sized table); the result is a scalar subquery.
    """
    ranked = (attribution.groupBy("feature").agg(F.max("mean_abs").alias("m"))
              .select(F.sort_array(F.collect_list(F.struct(F.negative("m").alias("neg"), "feature"))).alias("a")))
    return ranked.select(F.transform("a", lambda s: s["feature"]).alias("a")).scalar()


def active_features(shared: Column, extras: Column, k: int = TOP_EXTRA_FEATURES) -> Column:
    """Catalog order of shared plus the first k extras not already shared."""
    new = F.slice(F.filter(extras, lambda f: ~F.array_contains(shared, f)), 1, k)
    return F.filter(_catalog(), lambda f: F.array_contains(shared, f) | F.array_contains(new, f))


def input_completeness(batch: DataFrame, active: Sequence[str]) -> DataFrame:
    """Per active feature, rows supplied vs rows falling back to the default.

    Raises when no active feature column is present at all (nothing to score).
    """
    present = [c for c in active if c in batch.columns]
    if not present:
        raise ValueError("batch has no recognised active feature column")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in active:
        if c in batch.columns:
            s = F.col(c).cast("string")
            aggs.append(F.count_if(s.isNotNull() & (s != "")).alias(c))
        else:
            aggs.append(F.lit(0).cast("bigint").alias(c))
    wide = batch.agg(*aggs)
    long = wide.unpivot(["_n"], list(active), "feature", "n_supplied")
    return long.select("feature", F.col("feature").isin(*present).alias("column_present"),
                       F.col("n_supplied").cast("bigint").alias("n_supplied"),
                       (F.col("_n") - F.col("n_supplied")).cast("bigint").alias("n_defaulted"))


@dataclass
class LinearScorer:
    """A fixed logistic scorer over catalog features (deterministic, SQL-checkable)."""
    intercept: float
    numeric: Mapping[str, float] = field(default_factory=dict)
    categorical: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    def logit(self) -> Column:
        z = F.lit(self.intercept)
        for name, w in self.numeric.items():
            z = z + F.lit(w) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        for name, table in self.categorical.items():
            m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
            z = z + F.coalesce(F.element_at(m, F.col(name)), F.lit(0.0))
        return z

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.logit()))

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.probability())


def confidence_columns(p: Column) -> dict[str, Column]:
    """J10."""
    conf = F.greatest(p, 1.0 - p)
    level = (F.when(conf >= HIGH_CONFIDENCE, F.lit("High")).when(conf >= MEDIUM_CONFIDENCE, F.lit("Medium"))
             .otherwise(F.lit("Low")))
    return {"confidence": F.format_string("%.1f%%", conf * 100.0), "confidence_level": level}


def drug_name(df: DataFrame, default: str = DEFAULT_DRUG, col: str = "drug_name") -> Column:
    """Per-row drug name when the batch has the column, else the parameter; blanks give the default."""
    base = F.col(col).cast("string") if col in df.columns else F.lit(default)
    t = F.trim(base)
    return F.coalesce(F.when(t != "", t), F.lit(default))


def _conformal(p: Column, q: Column | None, alpha: float) -> Column:
    if q is None:
        return F.lit(None).cast("struct<prediction:double,probability:double,alpha:double,"
                                "set_contains_0:double,set_contains_1:double>")
    cut = 1.0 - q
    return F.struct(F.when(p > 0.5, 1.0).otherwise(0.0).alias("prediction"), p.alias("probability"),
                    F.lit(alpha).alias("alpha"),
                    F.when((1.0 - p) >= cut, 1.0).otherwise(0.0).alias("set_contains_0"),
                    F.when(p >= cut, 1.0).otherwise(0.0).alias("set_contains_1"))


def score_batch(batch: DataFrame, response_model, mortality_model, *,
                response_threshold: float = DEFAULT_THRESHOLD, mortality_threshold: float = DEFAULT_THRESHOLD,
                response_algorithm: str | None = None, mortality_algorithm: str | None = None,
                response_q: Column | None = None, mortality_q: Column | None = None, alpha: float = 0.1,
                drug: str = DEFAULT_DRUG, keep: Sequence[str] = ("row_id",), load_errors: Mapping[str, Sequence[str]] | None = None,
                on_invalid: str = "default") -> DataFrame:
    """J8-J11 + J14: one output row per input row; both tasks scored independently.

    ``*_model`` is anything with ``transform(df, out_col)`` (a ``LinearScorer`` or a
    fitted-pipeline adapter) or None when that model is unavailable.
    """
    keep = [k for k in keep if k in batch.columns]
    d = drug_name(batch)
    typed = coerce_feature_types(normalize_payload(batch.withColumn("_drug", d), on_invalid=on_invalid, keep=[*keep, "_drug"]))
    if response_model is None or mortality_model is None:  # J11 availability gate
        errs = load_errors or {}
        msg = (f"Model unavailable. Response load: {'; '.join(list(errs.get('response', []))[:2]) or 'none'}. "
               f"Mortality load: {'; '.join(list(errs.get('mortality', []))[:2]) or 'none'}.")
        return typed.select(*keep, F.lit(None).cast("double").alias("probability"), F.lit(NOT_TRAINED).alias("label"),
                            F.lit("0.0%").alias("confidence"), F.lit("Low").alias("confidence_level"),
                            F.lit(None).cast("double").alias("mortality_probability"),
                            F.lit(NOT_TRAINED).alias("mortality_label"), F.col("_drug").alias("drug_name"),
                            F.lit("tree-stack-unavailable").alias("model_type"),
                            F.lit(None).cast("string").alias("response_algorithm"),
                            F.lit(None).cast("string").alias("mortality_algorithm"),
                            F.lit(msg).alias("mortality_message"))
    scored = mortality_model.transform(response_model.transform(typed, "_p_resp"), "_p_mort")
    p, pm = F.col("_p_resp"), F.col("_p_mort")
    conf = confidence_columns(p)
    model_type = (f"Tree stack split models (response={response_algorithm}, mortality={mortality_algorithm})")
    return scored.select(
        *keep, p.alias("probability"),
        F.when(p >= response_threshold, F.lit(RESPONSE_POSITIVE)).otherwise(F.lit(RESPONSE_NEGATIVE)).alias("label"),
        conf["confidence"].alias("confidence"), conf["confidence_level"].alias("confidence_level"),
        pm.alias("mortality_probability"),
        F.when(pm >= mortality_threshold, F.lit(MORTALITY_HIGH)).otherwise(F.lit(MORTALITY_LOW)).alias("mortality_label"),
        F.col("_drug").alias("drug_name"), F.lit(model_type).alias("model_type"),
        F.lit(response_algorithm).cast("string").alias("response_algorithm"),
        F.lit(mortality_algorithm).cast("string").alias("mortality_algorithm"),
        F.lit(INDEPENDENT_MESSAGE).alias("mortality_message"),
        _conformal(p, response_q, alpha).alias("response_conformal"),
        _conformal(pm, mortality_q, alpha).alias("mortality_conformal"))


def deployment_status(selected: DataFrame) -> DataFrame:
    """One status row from the selected runs table (one row per task)."""
    def pick(task: str, col: str) -> Column:
        return F.max(F.when(F.col("task") == task, F.col(col)))
    agg = selected.agg(pick("response", "algorithm").alias("response_algorithm"),
                       pick("mortality", "algorithm").alias("mortality_algorithm"),
                       pick("response", "threshold").alias("_rt"), pick("mortality", "threshold").alias("_mt"))
    ready_r = F.col("response_algorithm").isNotNull()
    ready_m = F.col("mortality_algorithm").isNotNull()
    return agg.select(ready_r.alias("response_model_ready"), ready_m.alias("mortality_model_ready"),
                      F.lit(len(FEATURE_ORDER)).alias("feature_count"),
                      decision_threshold(F.col("_rt")).alias("response_threshold"),
                      decision_threshold(F.col("_mt")).alias("mortality_threshold"),
                      "response_algorithm", "mortality_algorithm",
                      F.when(ready_r & ready_m, F.lit(READY_MODE)).otherwise(F.lit(UNAVAILABLE_MODE)).alias("mode"))


def score_payload(spark, payload: Mapping[str, object], response_model, mortality_model, **kw) -> DataFrame:
    """One form payload scored like a batch of one row (missing fields take defaults, text as typed)."""
    names = [n for n in FEATURE_ORDER if n in payload] + (["drug_name"] if "drug_name" in payload else [])
    row = [None if payload[n] is None else str(payload[n]) for n in names]
    df = spark.createDataFrame([row], ", ".join(f"`{n}` string" for n in names) or "dummy string")
    return score_batch(df, response_model, mortality_model, keep=(), **kw)
