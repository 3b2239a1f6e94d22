"""Calibration of scores to probabilities by isotonic steps, and the gate that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import ece, isotonic, quadrants, step_lookup
from .ranking import quadrant


def clipped(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def fit(rows: DataFrame, score: Column, correct: Column) -> DataFrame:
    """x_start, p: the isotonic steps of correctness over the score. No rows give no steps."""
    return isotonic(rows.withColumn("_all", F.lit(1)), score, correct.cast("double"), ["_all"]).drop("_all")


def expected_error(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """One row: n, ece; null without rows."""
    return ece(rows, confidence, correct, bins).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("part").alias("ece"))


def calibration_gain(rows: DataFrame, score: Column, correct: Column, bins: int = 10) -> DataFrame:
    """One row: n, n_pos, ece_before (of the clipped score) and ece_after (of the steps fitted to the same rows)."""
    told = rows.select(score.alias("_s"), correct.alias("_y"))
    after = step_lookup(told, F.col("_s"), fit(told, F.col("_s"), F.col("_y")))
    counts = told.agg(F.count("*").alias("n"), F.count_if("_y").alias("n_pos"))
    before = expected_error(told, clipped(F.col("_s")), F.col("_y"), bins).select(F.col("ece").alias("ece_before"))
    return counts.crossJoin(before).crossJoin(expected_error(after, F.col("p"), F.col("_y"), bins).select(F.col("ece").alias("ece_after")))


def gate_at(rows: DataFrame, score: Column, correct: Column, steps: DataFrame, least: float) -> DataFrame:
    """One row: quadrants, coverage and risk of a gate that passes what the steps give a probability of least or more."""
    told = step_lookup(rows.select(score.alias("_s"), correct.alias("_y")), F.col("_s"), steps)
    q = quadrant(F.when(F.col("p") >= least, "confident").otherwise("held"), F.col("_y"))
    return quadrants(told, [], q)


def class_counts(rows: DataFrame, decision: Column) -> DataFrame:
    """One row: how many decisions are confident and how many aren't."""
    return rows.agg(F.count_if(decision == "confident").alias("confident"), F.count_if(~F.coalesce(decision == "confident", F.lit(False))).alias("non_confident"))


def usable(counts: DataFrame, calib_rows: int, least_rows: int = 300, least_each: int = 50) -> bool:
    """Whether a calibration may be stored: enough rows, and enough of either class. counts: of class_counts, one row."""
    row = counts.head()
    return calib_rows >= least_rows and min(row.confident, row.non_confident) >= least_each
