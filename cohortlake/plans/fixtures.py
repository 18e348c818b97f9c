"""Clinical-shaped inputs derived from the driver's tables.

Each recipe is a list of SQL expressions valid in Spark SQL and DuckDB
(``{S}`` is the string type name of the engine).  Spark evaluates them
with ``selectExpr`` over a parquet scan, so every derived table grows
with the scale factor; ``duck(name)`` renders the same recipe as a CTE
body for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import REGISTRY_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table; its plan is made once per session."""
    try:
        owner = spark.sparkContext.applicationId  # a restarted session never reuses a stale plan
    except Exception:  # noqa: BLE001 - remote session
        owner = id(spark)
    key = (owner, sf_dir, name)
    if key in _SCANS:
        return _SCANS[key]
    df = _spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    _SCANS[key] = df
    return df


#: Rows of a scan's task. A file of one row group is read by one task, and the long recode expressions after it would run there.
TASK_ROWS = 25_000


def _spread(df: DataFrame) -> DataFrame:
    """The rows over enough tasks where the files' row groups give too few; small tables stay as they are scanned."""
    parts = -(-df.count() // TASK_ROWS)  # counted from the files' footers
    try:
        scanned = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - remote session
        scanned = 1
    return df.repartition(parts) if parts > scanned else df


# Lazy scan plans per (session, folder, table): the read-only inputs are planned once per session.
_SCANS: dict = {}


# Registry export (one row per tumour) from `orders`.
REGISTRY = ("orders", [
    ("row_id", "o_orderkey"),
    ("age_raw", "split_part('60-64 years|65-69 years|90+ years|00 years|Unknown|72','|',cast(1+o_orderkey%6 as int))"),
    ("sex_raw", "split_part('Male|FEMALE| female |Unknown|Intersex','|',cast(1+o_orderkey%5 as int))"),
    ("race_raw", "split_part('White|Black|Asian or Pacific Islander|American Indian/Alaska Native|Unknown|Caucasian|Multi','|',cast(1+o_custkey%7 as int))"),
    ("marital_raw", "split_part('Married (including common law)|Single (never married)|Divorced|Widowed|Separated|Unmarried or Domestic Partner|Unknown','|',cast(1+(o_orderkey+o_custkey)%7 as int))"),
    ("hist_raw", "split_part('Adenocarcinoma, NOS|Squamous cell|Non-small cell carcinoma|Small cell|Large cell|8140|NA','|',cast(1+o_orderkey%7 as int))"),
    ("stage_raw", "split_part('Stage IIIA|IV|stage  I B|N/A|Stage|STAGE IIB','|',cast(1+o_orderkey%6 as int))"),
    ("t_raw", "split_part('T2a|t 1b|Blank(s)|TX','|',cast(1+o_custkey%4 as int))"),
    ("n_raw", "split_part('N0|n 2|Blank(s)|NX|N/A','|',cast(1+o_orderkey%5 as int))"),
    ("m_raw", "split_part('M0|M1b|Blank(s)|m1a','|',cast(1+(o_orderkey+1)%4 as int))"),
    ("chemo_raw", "split_part('Yes|No/Unknown|','|',cast(1+o_orderkey%3 as int))"),
    ("radiation_raw", "split_part('Beam radiation|None/Unknown|Combination of beam with implants|Refused|Recommended, unknown if given|Radioisotopes','|',cast(1+o_orderkey%6 as int))"),
    ("delay_raw", "case when o_orderkey%9=0 then 'Blank(s)' else cast((o_orderkey*13)%1100 as {S}) end"),
    ("tumor_raw", "split_part('035|999|Blank(s)|120|1000|Unable to calculate','|',cast(1+o_orderkey%6 as int))"),
    ("tumor_summary_raw", "case when o_orderkey%4=0 then 'Blank(s)' else cast(o_custkey%150 as {S}) end"),
    ("mets_raw", "split_part('Yes|No/Unknown|Yes, distant|Unknown','|',cast(1+o_custkey%4 as int))"),
    ("survival_raw", "case when o_orderkey%11=0 then 'NA' else cast(o_custkey%30 as {S}) end"),
    ("vital_raw", "split_part('Dead|Alive','|',cast(1+o_custkey%2 as int))"),
])

# Registry short name -> canonical key of REGISTRY_COLUMNS.
REGISTRY_SHORT = {
    "age_raw": "age", "sex_raw": "sex", "race_raw": "race_recode", "marital_raw": "marital_status",
    "hist_raw": "histology", "stage_raw": "cancer_stage", "t_raw": "t_stage", "n_raw": "n_stage",
    "m_raw": "m_stage", "chemo_raw": "chemotherapy_cycles", "radiation_raw": "radiation_recode",
    "delay_raw": "treatment_delay_days", "tumor_raw": "tumor_size_recode",
    "tumor_summary_raw": "tumor_size_summary", "mets_raw": "mets_lung_dx",
    "survival_raw": "survival_months", "vital_raw": "vital_status",
}

# Case table (one row per case) from `customer`.
CASES = ("customer", [
    ("case_id", "c_custkey"),
    ("submitter_id", "concat('SUB',cast(c_custkey as {S}))"),
    ("project_id", "case when c_custkey%3=0 then null else split_part('TCGA-LUAD|TCGA-LUSC','|',cast(1+c_custkey%2 as int)) end"),
    ("gender", "split_part('male|female|not reported','|',cast(1+c_custkey%3 as int))"),
    ("primary_diagnosis", "split_part('Adenocarcinoma, NOS|Squamous cell carcinoma, NOS|Small cell carcinoma|Not Reported','|',cast(1+c_custkey%4 as int))"),
    ("tumor_stage", "split_part('stage ia|stage iiib|Stage IV|not reported','|',cast(1+c_custkey%4 as int))"),
    ("age_at_diagnosis_days", "20000+c_custkey%9000"),
    ("vital_status", "split_part('Dead|Alive|Not Reported','|',cast(1+c_custkey%3 as int))"),
    ("days_to_death", "case when c_custkey%4=0 then null else c_custkey%800 end"),
    ("days_to_last_follow_up", "(c_custkey*7)%900"),
    ("ecog_all_null", "cast(null as double)"),
    ("ecog_half_null", "case when c_custkey%2=0 then cast(c_custkey%5 as double) end"),
    ("karnofsky_best", "cast(10*(c_custkey%11) as double)"),
    ("tf_tumor_free_count", "case when c_custkey%5=0 then 1 else 0 end"),
    ("wt_with_tumor_count", "case when c_custkey%7=0 then 1 else 0 end"),
    ("best_disease_response", "split_part('WT-With Tumor|TF-Tumor Free|Not Available|','|',cast(1+c_custkey%4 as int))"),
])

# Follow-up / diagnosis rows (one per line item, nested per order into case documents).
FOLLOW_UPS = ("lineitem", [
    ("case_id", "l_orderkey"),
    ("line", "l_linenumber"),
    ("ecog", "case when (l_orderkey+l_linenumber)%4=0 then 'x' else cast(l_partkey%5 as {S}) end"),
    ("karnofsky", "case when l_linenumber%3=0 then null else cast(10*(l_suppkey%11) as {S}) end"),
    ("prior_treatment", "split_part('yes|no|Not Reported| No |unknown','|',cast(1+(l_partkey+l_linenumber)%5 as int))"),
])

# Entity-attribute-value study rows from `events`.
EAV = ("events", [
    ("seq", "event_id"),
    ("sample_id", "concat('S',cast(user_id as {S}))"),
    ("patient_id", "concat('P',cast(user_id%40 as {S}))"),
    ("study_id", "concat('study',cast(user_id%3 as {S}))"),
    ("attr", "case event_type when 'click' then 'AGE_AT_SEQ_REPORTED_YEARS' when 'view' then 'PREDOMINANT_HISTOLOGIC_SUBTYPE' when 'purchase' then 'PATHOLOGIC_STAGE' else 'OTHER_ATTRIBUTE' end"),
    ("value", "case when event_id%4=0 then null when event_type='click' then cast(30+event_id%60 as {S}) when event_type='view' then 'Adenocarcinoma' else 'Stage IIA' end"),
])

# Mutation panel rows from `lineitem`.
MUTATIONS = ("lineitem", [
    ("sample_key", "l_orderkey"),
    ("patient_id", "concat('P',cast(l_suppkey as {S}))"),
    ("gene", "split_part('hugoGeneSymbol=EGFR;id=1956|hugoGeneSymbol=KRAS;id=3845|tp53|123|NA','|',cast(1+(l_partkey+l_linenumber)%5 as int))"),
])

# Deterministic scores and outcomes from `orders`.
SCORED = ("orders", [
    ("row_id", "o_orderkey"),
    ("p", "cast((o_orderkey*7919+o_custkey*104729)%10007 as double)/10007"),
    ("y", "case when (o_orderkey*7919+o_custkey*104729)%10007 + (o_orderkey*6151)%4001 > 7000 then 1 else 0 end"),
])

# Labeled documents (text metadata + binary targets).
DOC_LABELS_SQL = ("select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                  "from documents d join labels l on d.doc_id = l.doc_id")

RECIPES = {"registry_raw": REGISTRY, "case_raw": CASES, "follow_up_raw": FOLLOW_UPS,
           "eav_raw": EAV, "mutation_raw": MUTATIONS, "scored": SCORED}


def _exprs(recipe, string_type: str) -> list[str]:
    return [f"{expr.format(S=string_type)} as {alias}" for alias, expr in recipe[1]]


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    recipe = RECIPES[name]
    return table(spark, sf_dir, recipe[0]).selectExpr(*_exprs(recipe, "string"))


def duck(name: str) -> str:
    """The recipe as a DuckDB SELECT (CTE body)."""
    if name == "doc_labels":
        return DOC_LABELS_SQL
    recipe = RECIPES[name]
    return f"select {', '.join(_exprs(recipe, 'varchar'))} from {recipe[0]}"


def registry_raw(spark, sf_dir):
    return derive(spark, sf_dir, "registry_raw")


def registry_export(spark, sf_dir) -> DataFrame:
    """The registry recipe with the export's own header names, all text (as a CSV scan gives)."""
    raw = registry_raw(spark, sf_dir)
    return raw.select(F.col("row_id").cast("string").alias("row_id"),
                      *[F.col(s).cast("string").alias(REGISTRY_COLUMNS[c]) for s, c in REGISTRY_SHORT.items()])


def case_raw(spark, sf_dir):
    return derive(spark, sf_dir, "case_raw")


def nested_cases(spark, sf_dir) -> DataFrame:
    """Case documents: per order, arrays of follow-up and diagnosis structs.

    An order has at most seven line items, so every array is bounded.
    Every tenth case has a NULL follow-up array.
    """
    rows = derive(spark, sf_dir, "follow_up_raw")
    fu = F.struct(F.col("ecog").alias("ecog_performance_status"),
                  F.col("karnofsky").alias("karnofsky_performance_status"))
    return (rows.groupBy("case_id")
            .agg(F.array_sort(F.collect_list(F.struct("line", fu.alias("fu")))).alias("_fu"),
                 F.array_sort(F.collect_list(F.struct("line", F.struct("prior_treatment").alias("dg")))).alias("_dg"))
            .select(F.col("case_id"),
                    F.when(F.col("case_id") % 10 != 0, F.transform("_fu", lambda s: s["fu"])).alias("follow_ups"),
                    F.transform("_dg", lambda s: s["dg"]).alias("diagnoses")))


#: Documents of one JSON array; more of them go to several files, so that no task writes them all.
ARRAY_DOCUMENTS = 100_000


def write_json_arrays(docs: DataFrame, path: str, key: str) -> None:
    """Rows as JSON objects in arrays, a file each, under ``path``; each array ends with a null, an empty table gives one array."""
    files = max(1, -(-docs.count() // ARRAY_DOCUMENTS))
    file = F.pmod(F.xxhash64(key), F.lit(files)).alias("file")
    lines = docs.select(file, F.lit(1).alias("o"), F.concat(F.to_json(F.struct(*docs.columns)), F.lit(",")).alias("value"))
    ends = docs.sparkSession.range(files).select(F.col("id").alias("file"), F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("[").alias("value")), F.struct(F.lit(2).alias("o"), F.lit("null]").alias("value")))).alias("e"))
    both = lines.unionByName(ends.select("file", "e.o", "e.value"))
    # a file's rows meet in one task, sorted, and are written below a folder of their own
    both.repartition(files, "file").sortWithinPartitions("file", "o").select("file", "value").write.partitionBy("file").text(path)


def eav_raw(spark, sf_dir):
    return derive(spark, sf_dir, "eav_raw")


def mutation_raw(spark, sf_dir):
    return derive(spark, sf_dir, "mutation_raw")


def scored(spark, sf_dir):
    return derive(spark, sf_dir, "scored")


def doc_labels(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id")


# Per-run scores: two tasks x three algorithms over `orders` (integer hashes, identical in both engines).
_H1 = "(o_orderkey*7919+o_custkey*104729)%10007"
_H2 = "(o_orderkey*104729+o_custkey*7919)%10007"
RUN_SCORES = ("orders", [
    ("row_id", "o_orderkey"),
    ("y_mortality", f"case when {_H1} + (o_orderkey*6151)%4001 > 7000 then 1 else 0 end"),
    ("y_response", f"case when {_H2} + (o_custkey*613)%4001 > 9000 then 1 else 0 end"),
    ("p_mortality_lightgbm", f"cast({_H1} as double)/10007"),
    ("p_mortality_xgboost", f"cast({_H1} + (o_orderkey*31)%2000 as double)/12007"),
    ("p_mortality_tabnet", f"cast({_H1} + (o_orderkey*17)%6000 as double)/16007"),
    ("p_response_lightgbm", f"cast({_H2} + (o_orderkey*29)%3000 as double)/13007"),
    ("p_response_xgboost", f"cast({_H2} as double)/10007"),
    ("p_response_tabnet", f"cast({_H2} + (o_orderkey*13)%8000 as double)/18007"),
])
RECIPES["run_scores"] = RUN_SCORES
RUN_TASKS = ("mortality", "response")
RUN_ALGORITHMS = ("lightgbm", "xgboost", "tabnet")


def run_scores(spark, sf_dir) -> DataFrame:
    """Long (task, algorithm, row_id, y, p) table: one row per order per run."""
    w = derive(spark, sf_dir, "run_scores")
    runs = [F.struct(F.lit(t).alias("task"), F.lit(a).alias("algorithm"), F.col(f"y_{t}").alias("y"),
                     F.col(f"p_{t}_{a}").alias("p")) for t in RUN_TASKS for a in RUN_ALGORITHMS]
    return w.select("row_id", F.explode(F.array(*runs)).alias("r")).select(
        "r.task", "r.algorithm", "row_id", "r.y", "r.p")


def duck_run_scores_long() -> str:
    body = duck("run_scores")
    parts = [f"select '{t}' as task, '{a}' as algorithm, row_id, y_{t} as y, p_{t}_{a} as p from rs"
             for t in RUN_TASKS for a in RUN_ALGORITHMS]
    return f"rs as ({body}), lg as ({' union all '.join(parts)})"
