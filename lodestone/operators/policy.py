"""Whom to target: top-budget and cost-aware policies, their value, tails, scenarios, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.order_statistics import quantiles
from lodestone.operators.ranking import row_numbers


def top_budget(df: DataFrame, score: str, budget: float, eligible: Column | None = None, out: str = "target") -> DataFrame:
    """``df`` with target 1 for the floor(n * budget) highest eligible scores (n counts all rows), ties by row_id."""
    n = df.agg(F.floor(F.count("*") * F.lit(float(budget))).alias("_k"))
    able = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    d = row_numbers(df.withColumn("_able", able.cast("int")), [F.desc("_able"), F.desc(score), F.asc("row_id")]).join(n)
    return d.withColumn(out, ((F.col("rn") <= F.col("_k")) & (F.col("_able") == 1)).cast("int")).drop("rn", "_k", "_able")


def cost_aware(df: DataFrame, effect: str, budget: float, value: float, cost: float, out: str = "target") -> DataFrame:
    """Top-budget by expected net value, among rows where it is over 0."""
    net = F.lit(float(value)) * F.col(effect) - F.lit(float(cost))
    return top_budget(df.withColumn("_net", net), "_net", budget, F.col("_net") > 0, out).drop("_net")


def policy_value(df: DataFrame, target: str, signal: str, value: float = 1.0, cost: float = 0.0, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(F.col(target) * (F.lit(float(value)) * F.col(signal) - F.lit(float(cost)))).alias("policy_value"), F.avg(target).alias("target_share"))


def sensitivity_grid(df: DataFrame, score: str, signal: str, budgets: list[float], costs: list[float]) -> DataFrame:
    """Net value of top-budget policies for each budget and cost, and the cost at which it is 0; one ranking for all."""
    d = row_numbers(df.select("row_id", score, signal), [F.desc(score), F.asc("row_id")])
    n = d.agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget")
    g = d.join(n).select("rn", signal, "n", grid).where(F.col("rn") <= F.floor(F.col("n") * F.col("budget")))
    g = g.groupBy("budget", "n").agg(F.sum(signal).alias("s"), F.count("*").alias("k"))
    g = g.select("budget", (F.col("s") / F.col("n")).alias("gross"), (F.col("k") / F.col("n")).alias("target_share"), F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost"))
    return g.select("budget", "cost", "gross", "target_share", (F.col("gross") - F.col("cost") * F.col("target_share")).alias("net"), F.try_divide("gross", "target_share").alias("break_even_cost"))


def tail_support(df: DataFrame, score: str, budgets: list[float], treatment: str = "treatment", outcome: str = "outcome") -> DataFrame:
    """Rows, arms and events of each top share, and how many rows of the whole table tie with its last score."""
    d = row_numbers(df.select("row_id", F.col(score).alias("s"), F.col(treatment).alias("t"), F.col(outcome).alias("y")), [F.desc("s"), F.asc("row_id")])
    n = d.agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget")
    g = n.select("n", grid).select("budget", F.floor(F.col("n") * F.col("budget")).alias("k"))
    top = d.join(F.broadcast(g), F.col("rn") <= F.col("k"))  # a row a budget
    a = top.groupBy("budget", "k").agg(F.sum("t").alias("n_treated"), F.sum(1 - F.col("t")).alias("n_control"), F.sum(F.col("t") * F.col("y")).alias("events_treated"), F.sum((1 - F.col("t")) * F.col("y")).alias("events_control"), F.min("s").alias("s"))
    ties = d.groupBy("s").agg(F.count("*").alias("ties"))
    a = a.join(ties, "s", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = g.join(a.drop("k"), "budget", "left")
    return out.select("budget", F.col("k").cast("bigint").alias("n_target"), zero("n_treated"), zero("n_control"), zero("events_treated"), zero("events_control"), F.coalesce("ties", F.lit(0)).cast("bigint").alias("boundary_tie_size"))


def tail_overlap(df: DataFrame, a: str, b: str, budgets: list[float]) -> DataFrame:
    """Overlap and Jaccard index of the top shares of two scores."""
    d = row_numbers(row_numbers(df.select("row_id", a, b), [F.desc(a), F.asc("row_id")], out="ra"), [F.desc(b), F.asc("row_id")], out="rb")
    n = d.agg(F.count("*").alias("n"))
    g = n.select("n", F.explode(F.array(*[F.lit(float(x)) for x in budgets])).alias("budget")).select("budget", F.floor(F.col("n") * F.col("budget")).alias("k"))
    j = d.join(F.broadcast(g), F.least("ra", "rb") <= F.col("k"))
    o = j.groupBy("budget").agg(F.count_if((F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k"))).alias("both"), F.count("*").alias("either"))
    o = g.join(o, "budget", "left").withColumns({"both": F.coalesce("both", F.lit(0)), "either": F.coalesce("either", F.lit(0))})
    return o.select("budget", "both", "either", F.coalesce(F.try_divide("both", "k"), F.lit(1.0)).alias("overlap"), F.coalesce(F.try_divide("both", "either"), F.lit(1.0)).alias("jaccard"))


def ordering_condition(df: DataFrame, score: str, p0: str, beta: str, budgets: list[float]) -> DataFrame:
    """Greatest baseline probability in each top share, and whether it is under (1 - beta) / 2 with the greatest beta there."""
    d = row_numbers(df.select("row_id", score, p0, beta), [F.desc(score), F.desc("row_id")])
    n = d.agg(F.count("*").alias("n"))
    g = n.select("n", F.explode(F.array(*[F.lit(float(x)) for x in budgets])).alias("budget")).select("budget", F.greatest(F.floor(F.col("n") * F.col("budget")), F.lit(1)).alias("k"))
    o = d.join(F.broadcast(g), F.col("rn") <= F.col("k")).groupBy("budget").agg(F.max(p0).alias("theta_max"), F.max(beta).alias("beta_max"))
    return o.withColumn("holds", (F.col("theta_max") < (1 - F.col("beta_max")) / 2).cast("int"))


def percentile_grid(df: DataFrame, score: str, points: int = 1001) -> DataFrame:
    """(value, quantile) with distinct values, the lowest quantile of equals."""
    q = quantiles(df, score, [i / (points - 1) for i in range(points)])
    return q.select(F.posexplode("q").alias("i", "value")).groupBy("value").agg((F.min("i") / (points - 1)).alias("quantile"))


def percentiles(df: DataFrame, score: str, grid: DataFrame) -> DataFrame:
    """``df`` with its score's percentile in a population by straight lines between grid points; null scores have none.

    A score is found by halving steps in the sorted grid, which has at most a few thousand points.
    """
    g = grid.agg(F.array_sort(F.collect_list(F.struct("value", "quantile"))).alias("_g")).where(F.size("_g") > 0)
    g = g.select(F.transform("_g", lambda x: x["value"]).alias("_v"), F.transform("_g", lambda x: x["quantile"]).alias("_q"))
    top = F.floor(F.log2(F.size("_v"))).cast("int")
    g = g.withColumn("_step", F.transform(F.sequence(F.lit(0), top), lambda i: F.pow(F.lit(2), top - i).cast("int")))
    d, x = df.join(F.broadcast(g), how="left"), F.col(score)
    ahead = lambda at, step: (at + step <= F.size("_v")) & (F.get("_v", at + step - 1) <= x)
    d = d.withColumn("_at", F.aggregate("_step", F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at)))
    lo, hi, q_lo, q_hi = (F.get(c, F.col("_at") - k) for c, k in (("_v", 1), ("_v", 0), ("_q", 1), ("_q", 0)))
    between = q_lo + (x - lo) / (hi - lo) * (q_hi - q_lo)
    at = F.when(x.isNull(), None).when(F.col("_at") == 0, q_hi).when((F.col("_at") == F.size("_v")) | (lo == x), q_lo).otherwise(between)
    return d.withColumn("percentile", at).drop("_v", "_q", "_step", "_at")


def batch_target(df: DataFrame, score: str, budget: float, grid: DataFrame) -> DataFrame:
    """``df`` with target, the floor(n * budget) highest scores of the batch, and percentile in the population of ``grid``."""
    return percentiles(top_budget(df, score, budget), score, grid)


def simulate(curve: DataFrame, budget: float, audience: int, value: float, cost: float) -> DataFrame:
    """Scenario from a curve (budget, value, ci_low, ci_high): totals, break-even cost; a budget outside it raises."""
    from lodestone.operators.curves import interpolate

    out = None
    for c in ("value", "ci_low", "ci_high"):
        part = interpolate(curve, [budget], [], "budget", c, "at").select("at", F.col("value").alias(c))
        out = part if out is None else out.join(part, "at")
    span = curve.agg(F.min("budget").alias("lo"), F.max("budget").alias("hi"))
    fine = F.when((F.col("at") < F.col("lo")) | (F.col("at") > F.col("hi")), F.raise_error("the budget is outside the evidence").cast("double")).otherwise(F.lit(float(value)))
    out = out.join(span).withColumn("_v", fine)
    gross = F.col("value") * F.col("_v")
    net = gross - F.lit(float(cost)) * F.col("at")
    return out.select(
        F.col("at").alias("budget"), gross.alias("gross_per_customer"), net.alias("net_per_customer"), (net * audience).alias("net_total"), F.floor(F.col("at") * audience).alias("n_targeted"),
        (F.col("ci_low") * F.col("_v") - F.lit(float(cost)) * F.col("at")).alias("net_low"), (F.col("ci_high") * F.col("_v") - F.lit(float(cost)) * F.col("at")).alias("net_high"), F.try_divide(gross, "at").alias("break_even_cost"), F.lit(int(value > 0 and cost / value > 0.001)).alias("guardrail"),
    )
