"""Assessment of innovations: indicator scores, claims, overrides, states and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def indicator_scores(parameters: DataFrame) -> DataFrame:
    """innovation, indicator, score: the highest fulfilled parameter, never a sum; 0 without any."""
    return parameters.groupBy("innovation", "indicator").agg(F.coalesce(F.max(F.when(F.col("fulfilled"), F.col("score"))), F.lit(0)).alias("score"))


def total_scores(parameters: DataFrame, maximum: float) -> DataFrame:
    scores = indicator_scores(parameters).groupBy("innovation").agg(F.sum("score").alias("total"))
    return scores.withColumn("share", F.col("total") / F.lit(maximum))


def claim_verdict(claimed: Column, supported: Column) -> Column:
    """pass, revise or fail of a claimed score against the highest supported one."""
    return F.when(F.coalesce(supported, F.lit(0)) == 0, "fail").when(claimed <= supported, "pass").otherwise("revise")


#: What the machine's verdicts are in the reviewers' words.
DECISION_OF_VERDICT = {"LOLOS": "LOLOS", "PERLU_REVISI": "REVISI", "TIDAK_LOLOS": "TOLAK"}


def is_override(verdict: Column, decision: Column) -> Column:
    words = F.create_map(*(F.lit(x) for pair in DECISION_OF_VERDICT.items() for x in pair))
    return ~F.try_element_at(words, verdict).eqNullSafe(decision)


def override_rates(decisions: DataFrame, by: str) -> DataFrame:
    over = is_override(F.col("verdict"), F.col("decision"))
    return decisions.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("overrides"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def states(parameters: DataFrame) -> DataFrame:
    """innovation, remaining, closed indicators and whether all are: an indicator closes when every parameter has a decision."""
    each = parameters.groupBy("innovation", "indicator").agg(F.bool_and(F.col("decision").isNotNull()).alias("closed"))
    return each.groupBy("innovation").agg(F.count_if("closed").alias("closed"), F.count_if(~F.col("closed")).alias("remaining"), F.bool_and("closed").alias("final"))


def kappa(pairs: DataFrame, by: str) -> DataFrame:
    """Cohen's kappa of label and second_label per group, and its grade (0.6 and 0.8 are the thresholds); one count per cell."""
    cells = pairs.where("label is not null and second_label is not null").groupBy(by, "label", "second_label").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy(by, "label").agg(F.sum("n").alias("r"))
    columns = cells.groupBy(by, F.col("second_label").alias("label")).agg(F.sum("n").alias("c"))
    chance = rows.join(columns, [by, "label"]).groupBy(by).agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("x"))
    seen = cells.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("second_label"), F.col("n")).otherwise(0)).alias("same"))
    both = seen.join(chance, by, "left").withColumns({"po": F.col("same") / F.col("n"), "pe": F.coalesce("x", F.lit(0.0)) / F.col("n") / F.col("n")})
    k = F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return both.select(by, "n", k.alias("kappa")).withColumn("grade", F.when(F.col("kappa") >= 0.8, "strong").when(F.col("kappa") >= 0.6, "enough").otherwise("weak"))


def template(catalog: DataFrame) -> DataFrame:
    """A blank label row per active indicator and parameter."""
    return catalog.where("active").select(F.col("id").alias("indicator_id"), F.explode("parameters").alias("p")).select("indicator_id", F.col("p.id").alias("parameter_id"), F.col("p.score").alias("score"), F.lit("").alias("label"))


def submission(catalog: DataFrame) -> DataFrame:
    return catalog.where("active").select(F.col("id").alias("indicator_id"), F.lit("").alias("claimed_parameter_id"), F.lit("").alias("narrative"))
