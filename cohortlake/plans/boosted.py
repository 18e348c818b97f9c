"""A boosted ensemble that SQL can fit as well: rows, Spark run and the chained SQL of the same rounds.

Orders above a bar, learned from priority, month, day and a customer group
(features of few values, so both sides have every threshold); every
third order is held out.  The SQL writes each level of each tree as one
common table expression: sums of gradient and hessian by node, feature and
value, running sums, the best gain, the next nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting as B
from .fixtures import table

#: Features and label; the expressions mean the same in Spark and DuckDB.
FEATURES = ("cast(substr(o_orderpriority, 1, 1) as double)", "cast(month(o_orderdate) as double)", "cast(day(o_orderdate) as double)", "cast(o_custkey % 10 as double)")
LABEL = "cast(o_totalprice / 100000 + cast(substr(o_orderpriority, 1, 1) as double) - month(o_orderdate) / 4.0 > 3 as integer)"
FIT = B.Fit("orders", "orders", rounds=4, depth=2, step=0.3, stages=(1, 2))


def rows(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders")
    return t.select(F.lit("orders").alias("part"), F.col("o_orderkey").cast("string").alias("id"), F.array(*[F.expr(c) for c in FEATURES]).alias("features"),
                    F.expr(LABEL).alias("y"), F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(1.0).alias("weight"))


def sql(fit: B.Fit = FIT) -> str:
    """CTEs x (id, j, v) and m1, m2, ... (id, y, tr, m): margins after each round."""
    parts = [
        f"r as (select cast(o_orderkey as varchar) as id, {LABEL} as y, o_orderkey % 3 <> 0 as tr, " + ", ".join(f"{c} as f{j}" for j, c in enumerate(FEATURES)) + " from orders)",
        "x as (" + " union all ".join(f"select id, {j} as j, f{j} as v from r" for j in range(len(FEATURES))) + ")",
        "m0 as (select id, y, tr, (select ln(sum(y) / (count(*) - sum(y))) from r where tr) as m from r)"]
    for k in range(1, fit.rounds + 1):
        parts.append(f"g{k} as (select id, y, tr, m, 1 / (1 + exp(-m)) - y as g, 1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) as h from m{k - 1})")
        parts.append(f"n{k}_0 as (select id, 0 as node from g{k})")
        for d in range(fit.depth):
            n = f"n{k}_{d}"
            parts += [
                f"h{k}_{d} as (select node, j, v, sum(g) as g, sum(h) as h from g{k} join {n} using (id) join x using (id) where tr group by node, j, v)",
                f"c{k}_{d} as (select node, j, v, sum(g) over u as gl, sum(h) over u as hl, sum(g) over w as ga, sum(h) over w as ha from h{k}_{d} "
                "window u as (partition by node, j order by v rows unbounded preceding), w as (partition by node, j))",
                f"b{k}_{d} as (select node, j, v from (select *, gl * gl / (hl + {fit.l2}) + (ga - gl) * (ga - gl) / (ha - hl + {fit.l2}) - ga * ga / (ha + {fit.l2}) as gain from c{k}_{d} "
                f"where hl >= {fit.min_hessian} and ha - hl >= {fit.min_hessian}) where gain > 1e-9 qualify row_number() over (partition by node order by round(gain, 9) desc, j, v) = 1)",
                f"n{k}_{d + 1} as (select {n}.id, case when b.node is null then {n}.node when x.v <= b.v then 2 * {n}.node + 1 else 2 * {n}.node + 2 end as node "
                f"from {n} left join b{k}_{d} as b on b.node = {n}.node left join x on x.id = {n}.id and x.j = b.j)"]
        last = f"n{k}_{fit.depth}"
        parts.append(f"l{k} as (select node, -{fit.step} * sum(g) / (sum(h) + {fit.l2}) as value from g{k} join {last} using (id) where tr group by node)")
        parts.append(f"m{k} as (select g{k}.id, y, tr, m + coalesce(value, 0) as m from g{k} join {last} using (id) left join l{k} using (node))")
    return "with " + ", ".join(p.replace(" as (", " as materialized (", 1) for p in parts) + " "


SCORES_SQL = sql() + " union all ".join(f"select id, cast({k} as integer) as rounds, cast(y as integer) as y, round(1 / (1 + exp(-m)), 6) as p from m{k} where not tr" for k in FIT.scored)

#: Contributions of a row sum to its margin less the mean margin of the training rows (the background).
ATTRIBUTION_SQL = sql() + (f"select id, round(m - (select avg(m) from m{FIT.rounds} where tr), 6) as total, round((select avg(m) from m{FIT.rounds} where tr), 6) as base_value "
                           f"from m{FIT.rounds} where not tr")
