"""Experiment records: flattening, checks against a baseline, running bests, plateaus, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Limits of the F1 buckets.
BUCKETS = ((0.5, "critical"), (0.7, "weak"), (0.85, "moderate"))


def flatten(rows: DataFrame, fields: dict[str, tuple[str, float]]) -> DataFrame:
    """iteration and one column per name, from a nested path with a default."""
    return rows.select("iteration", *[F.coalesce(F.col(path).cast("double"), F.lit(default)).alias(name) for name, (path, default) in fields.items()])


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))


def bucket(f1: Column) -> Column:
    out = F.lit("good")
    for limit, name in reversed(BUCKETS):
        out = F.when(f1 < limit, name).otherwise(out)
    return out


def assess(results: DataFrame, baseline: DataFrame, forgetting_under: float = 0.90) -> DataFrame:
    """Deltas of new_f1 and old_f1 to the one-row baseline, and flags."""
    b = baseline.select(F.col("new_f1").alias("b_new"), F.col("old_f1").alias("b_old"))
    rows = results.crossJoin(F.broadcast(b.limit(1)))
    return rows.select(
        *results.columns, (F.col("new_f1") - F.col("b_new")).alias("new_delta"), (F.col("old_f1") - F.col("b_old")).alias("old_delta"),
        (F.col("new_f1") > F.col("b_new")).alias("improved"), (F.col("old_f1") < forgetting_under).alias("forgetting"),
    )


def drift(current: DataFrame, base: DataFrame, least: float = 0.05) -> DataFrame:
    """Classes (cls, value) that moved by more than `least`, worst first."""
    rows = current.join(base.select("cls", F.col("value").alias("base")), "cls").withColumn("delta", F.col("value") - F.col("base"))
    return rows.filter(F.abs("delta") > least).orderBy("delta", "cls")


def running_best(rows: DataFrame, by: Sequence[str] = (), order: str = "iteration", value: str = "new_f1", forgetting: str = "forgetting") -> DataFrame:
    """Rows that beat all rows before them, of those without forgetting."""
    before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    fine = rows.filter(~F.col(forgetting)).withColumn("__top", F.max(value).over(before))
    return fine.filter(F.col("__top").isNull() | (F.col(value) > F.col("__top"))).drop("__top")


def strategy_score(new_f1: Column, old_f1: Column, forgetting: Column) -> Column:
    return F.when(forgetting, new_f1 * 0.5).otherwise(new_f1 + 0.1 * old_f1)


def plateau(rows: DataFrame, by: Sequence[str] = (), order: str = "iteration", value: str = "new_f1", n: int = 3, under: float = 0.005) -> DataFrame:
    """plateau: the last n values are there and lie within `under`."""
    last = W.partitionBy(*by).orderBy(order).rowsBetween(1 - n, 0)
    spread = F.max(value).over(last) - F.min(value).over(last)
    return rows.withColumn("plateau", (F.count(value).over(last) == n) & (spread < under))


def idle(rows: DataFrame, by: Sequence[str] = (), order: str = "iteration", value: str = "harvested", n: int = 20) -> DataFrame:
    last = W.partitionBy(*by).orderBy(order).rowsBetween(1 - n, 0)
    return rows.withColumn("idle", (F.count(value).over(last) == n) & (F.sum(value).over(last) == 0))


def pivot_table(rows: DataFrame, row: str, column: str, values: Sequence, measure: str, order: str, missing: str = "--") -> DataFrame:
    """First measure of each row and column name in order; a column per listed value; `missing` for none."""
    firsts = rows.groupBy(row, column).agg(F.min_by(measure, order).alias("m"))
    wide = firsts.groupBy(row).pivot(column, list(values)).agg(F.first("m"))
    return wide.select(row, *[F.coalesce(F.col(f"`{v}`").cast("string"), F.lit(missing)).alias(f"{column}_{v}") for v in values])


def top_sources(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The source (src, precision, recall) with the best precision and the one with the best recall; if these are one, the
    second best by recall."""
    lists = rows.groupBy(*by).agg(F.max_by("src", F.struct("precision", (-F.col("src")).alias("o"))).alias("best_precision"), F.collect_list(F.struct(F.col("recall"), (-F.col("src")).alias("o"), "src")).alias("all"))
    rest = F.filter("all", lambda x: x["src"] != F.col("best_precision"))
    top = F.array_max("all")["src"]
    return lists.select(*by, "best_precision", F.when(top != F.col("best_precision"), top).otherwise(F.array_max(rest)["src"]).alias("best_recall"))


def budget(rows: DataFrame, order: Sequence[str], size: str, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows in order while their sizes add up to at most the limit."""
    run = F.sum(size).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__run", run).filter(F.col("__run") <= limit).drop("__run")


def latest_family(models: DataFrame, name: str = "name") -> DataFrame:
    """The last name of each family, the part before `_iter`."""
    return models.groupBy(F.split(name, "_iter")[0].alias("family")).agg(F.max(name).alias(name))


def distinct_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place of their first row."""
    return rows.groupBy(key).agg(F.min(order).alias("first_at"))


def tool_usage(log: DataFrame, meta: Sequence[str] = ()) -> DataFrame:
    """Per tool of a log (tool, seconds): calls, seconds, and its share of all calls but those of meta tools (null for them)."""
    per = log.groupBy("tool").agg(F.count("*").alias("calls"), F.sum("seconds").alias("seconds"))
    counts = ~F.col("tool").isin(*meta) if meta else F.lit(True)
    whole = per.agg(F.sum(F.when(counts, F.col("calls"))).alias("__all"))
    return per.crossJoin(F.broadcast(whole)).select("tool", "calls", "seconds", F.when(counts, F.col("calls") / F.col("__all")).alias("share"))  # one row
