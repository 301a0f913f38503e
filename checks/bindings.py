"""Views of the test tables that stand in for the analysed units, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiometra.domain import CUT_POINTS, DIMENSIONS, STATUS_ORDER, UPGRADE_BANDS, Columns
from regiometra.functions import round_half_even
from regiometra.operators.features import arg_min_column, classify_by_threshold, difference, ratio_to_mean

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is one."""
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round sums and averages, whose last bits depend on the order of addition."""
    return df.withColumns({c: round_half_even(F.col(f"`{c}`"), digits) for c in columns})


def rs(expression: str, digits: int = 6) -> str:
    """SQL twin of ``r``."""
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"round_even(({expression}) * {scale}, 0) / {scale}"


COLS = Columns(
    unit="unit", unit_name="unit", region="prov", district="flag", subdistrict="linestatus",
    social="iks", economic="ike", environment="ikl", score="idm", status="status",
    child_count="n_rec", child_total="total_rec", matched="matched", weakest="weakest",
    gap_economic="gap_e", gap_environment="gap_l", intensity="intensity",
    cluster="cluster_id", cluster_label="cluster_label")


def _derived(df: DataFrame) -> DataFrame:
    scored = df.withColumn("idm", (F.col("iks") + F.col("ike") + F.col("ikl")) / 3)
    return scored.withColumns({
        "status": classify_by_threshold("idm"),
        "weakest": arg_min_column(COLS.dimension_of),
        "gap_e": difference("iks", "ike"), "gap_l": difference("iks", "ikl")})


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    lines, suppliers, nations = (table(spark, folder, t) for t in ("lineitem", "supplier", "nation"))
    return (lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
            .join(nations, suppliers.s_nationkey == nations.n_nationkey))


def lines_view(spark: SparkSession, folder: str) -> DataFrame:
    """One unit per line (the key repeats)."""
    return _derived(_joined(spark, folder).select(
        F.col("l_orderkey").alias("unit"), F.col("n_name").alias("prov"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("linestatus"),
        F.col("l_linenumber").cast("bigint").alias("n_rec"),
        F.col("l_extendedprice").alias("total_rec"),
        (F.col("l_quantity") / 50).alias("iks"), (F.col("l_discount") * 10).alias("ike"),
        (F.col("l_tax") / 0.08).alias("ikl")))


def units_view(spark: SparkSession, folder: str) -> DataFrame:
    """One unit per order that has lines (unique key), with every modelling column."""
    grouped = (_joined(spark, folder).groupBy(F.col("l_orderkey").alias("unit"))
               .agg(F.min("n_name").alias("prov"), F.min("l_returnflag").alias("flag"),
                    F.min("l_linestatus").alias("linestatus"), F.count("*").alias("n_rec"),
                    F.max("l_extendedprice").alias("total_rec"),
                    (F.max("l_quantity") / 50).alias("iks"),
                    (F.max("l_discount") * 10).alias("ike"),
                    (F.min("l_tax") / 0.08).alias("ikl")))
    return _derived(grouped).withColumn("matched", F.col("n_rec") > 1)


def modeling_view(spark: SparkSession, folder: str) -> DataFrame:
    return ratio_to_mean(units_view(spark, folder), "n_rec", F.col("matched"), "intensity")


def _case_status(score: str) -> str:
    whens = " ".join(f"WHEN {score} < {c}::DOUBLE THEN '{s}'" for c, s in zip(CUT_POINTS, STATUS_ORDER))
    return f"CASE {whens} WHEN {score} IS NOT NULL THEN '{STATUS_ORDER[-1]}' END"


CASE_STATUS = _case_status("idm")
CASE_WEAKEST = (f"CASE WHEN least(iks, ike, ikl) = iks THEN '{DIMENSIONS[0]}' "
                f"WHEN least(iks, ike, ikl) = ike THEN '{DIMENSIONS[1]}' ELSE '{DIMENSIONS[2]}' END")
CASE_BAND = "CASE " + " ".join(
    f"WHEN status = '{s}' AND idm >= {lo}::DOUBLE AND idm < {hi}::DOUBLE THEN '{label}'"
    for s, lo, hi, label in UPGRADE_BANDS) + " ELSE 'Biasa' END"
_JOINED = ("lineitem JOIN supplier ON l_suppkey = s_suppkey "
           "JOIN nation ON s_nationkey = n_nationkey")
_DERIVED = f"*, {CASE_STATUS} AS status, {CASE_WEAKEST} AS weakest, iks - ike AS gap_e, iks - ikl AS gap_l"

V = f"""v0 AS (SELECT l_orderkey AS unit, n_name AS prov, l_returnflag AS flag,
  l_linestatus AS linestatus, l_linenumber::BIGINT AS n_rec, l_extendedprice AS total_rec,
  l_quantity / 50 AS iks, l_discount * 10 AS ike, l_tax / 0.08::DOUBLE AS ikl FROM {_JOINED}),
v1 AS (SELECT *, (iks + ike + ikl) / 3 AS idm FROM v0),
v AS (SELECT {_DERIVED} FROM v1)"""

U = f"""u0 AS (SELECT l_orderkey AS unit, min(n_name) AS prov, min(l_returnflag) AS flag,
  min(l_linestatus) AS linestatus, count(*) AS n_rec, max(l_extendedprice) AS total_rec,
  max(l_quantity) / 50 AS iks, max(l_discount) * 10 AS ike, min(l_tax) / 0.08::DOUBLE AS ikl
  FROM {_JOINED} GROUP BY l_orderkey),
u1 AS (SELECT *, (iks + ike + ikl) / 3 AS idm FROM u0),
u2 AS (SELECT {_DERIVED}, n_rec > 1 AS matched FROM u1),
u AS (SELECT *, n_rec / (SELECT avg(n_rec) FROM u2 WHERE matched) AS intensity FROM u2)"""
LAGGING_SQL = "status IN ('TERTINGGAL', 'SANGAT TERTINGGAL')"


def mode_sql(source: str, group: str, value: str) -> str:
    """(group, m): most frequent present value per group, the smallest on ties."""
    return (f"(SELECT {group}, {value} AS m FROM (SELECT {group}, {value}, row_number() OVER "
            f"(PARTITION BY {group} ORDER BY count(*) DESC, {value}) AS rn FROM {source} "
            f"WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY {group}, {value}) WHERE rn = 1)")
