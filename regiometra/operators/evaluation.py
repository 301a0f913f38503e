"""Classifier metrics, all derived from the counts of (actual, predicted)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: share of rows whose prediction equals the label."""
    hit = (F.col(f"`{actual}`") == F.col(f"`{predicted}`")).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def confusion_counts(df: DataFrame, actual: str, predicted: str,
                     by: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*by, F.col(f"`{actual}`").alias("actual"),
                       F.col(f"`{predicted}`").alias("predicted"))
            .agg(F.count("*").alias("n")))


def confusion_matrix(df: DataFrame, actual: str, predicted: str,
                     labels: Sequence[str]) -> DataFrame:
    """Rows actual, columns predicted, both alphabetical over the whole domain, zeros filled."""
    names = sorted(labels)
    domain = df.sparkSession.createDataFrame([(n,) for n in names], "actual string")
    counts = (confusion_counts(df, actual, predicted).groupBy("actual")
              .pivot("predicted", names).agg(F.sum("n")))
    filled = [F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("bigint").alias(n) for n in names]
    return domain.join(counts, "actual", "left").select("actual", *filled).orderBy("actual")


def classification_report(df: DataFrame, actual: str, predicted: str, labels: Sequence[str],
                          by: Sequence[str] = ()) -> DataFrame:
    """(label, precision, recall, f1, support): classes alphabetically, then accuracy and averages.

    Every class of the domain has a row; a zero divisor gives 0. With ``by`` (a model name, say)
    there is one report per group, from the same single pass.
    """
    names = sorted(labels)
    counts = confusion_counts(df, actual, predicted, by)
    hit = F.col("actual") == F.col("predicted")
    zero = F.lit(0).cast("bigint")
    # Each count serves its actual class, its predicted class, and brings in the whole domain.
    entries = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"),
                 zero.alias("predicted_n"), F.when(hit, F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"),
                 F.col("n").alias("predicted_n"), zero.alias("tp")),
        *[F.struct(F.lit(n).alias("label"), zero.alias("support"), zero.alias("predicted_n"),
                   zero.alias("tp")) for n in names])
    tallies = (counts.select(*by, F.inline(entries)).filter(F.col("label").isin(names))
               .groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted_n", "tp")]))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    p, r = ratio(F.col("tp"), F.col("predicted_n")), ratio(F.col("tp"), F.col("support"))
    classes = (tallies.withColumns({"precision": p, "recall": r})
               .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"),
                                       F.col("precision") + F.col("recall"))))
    scores = ("precision", "recall", "f1")
    weight = F.col("support").cast("double")
    rows = F.sum("support")
    summary = classes.groupBy(*by).agg(
        rows.alias("rows"), ratio(F.sum("tp"), rows).alias("acc"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[ratio(F.sum(F.col(s) * weight), rows).alias(f"weighted_{s}") for s in scores])

    def line(name: str, values: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("label"),
                        *[v.alias(s) for s, v in zip(scores, values)], F.col("rows").alias("support"))

    averages = summary.select(*by, F.inline(F.array(
        line("accuracy", [F.col("acc")] * 3),
        line("macro avg", [F.col(f"macro_{s}") for s in scores]),
        line("weighted avg", [F.col(f"weighted_{s}") for s in scores]))))
    return classes.select(*by, "label", *scores, "support").unionByName(averages)
