"""Counters with five states, and their mergeable summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAXIMUM = 2**63 - 1


def state(raw: str, minimum: int) -> Column:
    """missing, empty, invalid, out_of_range or valid."""
    text = F.trim(raw)
    number = F.expr(f"try_cast(trim({raw}) as decimal(38, 0))")
    digits = F.ltrim(F.lit("0"), F.regexp_replace(text, "^[+-]", ""))
    return (
        F.when(F.col(raw).isNull(), "missing")
        .when(text == "", "empty")
        .when(~text.rlike(r"^[+-]?[0-9]+\z"), "invalid")
        .when((F.length(digits) > 19) | ~number.between(F.lit(minimum).cast("decimal(38,0)"), F.lit(MAXIMUM).cast("decimal(38,0)")), "out_of_range")
        .otherwise("valid")
    )


def value(raw: str, minimum: int) -> Column:
    """The number where the state is valid, else null: never zero for an unknown."""
    return F.when(state(raw, minimum) == "valid", F.expr(f"try_cast(trim({raw}) as bigint)"))


def summary(state_column: str, value_column: str) -> list[Column]:
    """Aggregates of one counter over any group; partial sums combine before the shuffle."""
    of = lambda name: F.count_if(F.col(state_column) == name).alias(f"{name}_count")
    known, available, everything = F.sum(F.col(value_column).cast("decimal(38,0)")), F.count(value_column), F.count("*")
    return [
        everything.alias("eligible_count"), available.alias("available_count"),
        of("missing"), of("empty"), of("invalid"), of("out_of_range"),
        F.count_if(F.col(value_column) == 0).alias("zero_count"),
        known.cast("bigint").alias("sum_known"),
        F.when((available == everything) & (everything > 0), known).cast("bigint").alias("sum_complete"),
        (known.cast("double") / F.when(available > 0, available)).alias("mean"),
        F.max(value_column).alias("max_known"),
        (F.lit(100.0) * available / F.when(everything > 0, everything)).alias("coverage_percent"),
    ]


def cpu_population(prefix: str = "") -> list[Column]:
    """Wall time, coverage, and the time of the whole group that neither CPU nor DB explains, on the calls whose CPU time is valid."""
    cpu = F.col("cpu_us")
    on = lambda c: F.sum(F.when(cpu.isNotNull(), c))
    wall = F.coalesce(on(F.col("duration_us")), F.lit(0))
    rest = F.sum(F.col("duration_us") - cpu - F.coalesce("db_duration_us", F.lit(0)))  # of calls that tell both times
    floor = F.when(F.count("cpu_us") > 0, F.greatest(rest, F.lit(0)))
    return [
        F.count("cpu_us").alias(f"{prefix}cpu_available_count"),
        wall.alias(f"{prefix}cpu_wall_us"),
        (100.0 * F.count("cpu_us") / F.count("*")).alias(f"{prefix}cpu_coverage_percent"),
        F.when(F.sum("duration_us") > 0, 100.0 * wall / F.sum("duration_us")).alias(f"{prefix}cpu_wall_coverage_percent"),
        F.when(wall > 0, 100.0 * F.sum("cpu_us") / wall).alias(f"{prefix}cpu_percent_of_wall"),
        floor.alias(f"{prefix}unattributed_us_floor"),
        F.when(wall > 0, 100.0 * floor / wall).alias(f"{prefix}unattributed_percent_floor"),
        F.when(F.count("cpu_us") > 0, F.greatest(-rest, F.lit(0))).alias(f"{prefix}attribution_overflow_us"),
    ]
