"""Forecasts, budgets, recommendations and what following them would save."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.functions.dates import check_range
from meterlight.functions.measures import failed, ratio, spilled, spilled_remotely
from meterlight.operators.governance import Caller
from meterlight.operators.numbering import number_rows
from meterlight.operators.per_query import query_totals, times
from meterlight.plans.queries import REMOTE, failing_share
from meterlight.views import Day, UsageViews

MIB = 1024 * 1024
SCENARIOS = {"LOW": 0.8, "BASE": 1.0, "HIGH": 1.2}
EFFORT = {"RIGHT_SIZE": "LOW", "ERRORS": "MEDIUM", "SPILL": "HIGH"}
EFFORT_ORDER = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
SAVED_FRACTIONS = {"ERRORS": 0.5, "SPILL": 0.2}


def _fits(views: UsageViews, start: Day, end: Day) -> DataFrame:
    """Least squares of daily credits on the day index, per service type.

    The five sums are exact; the line is computed from them in doubles, once per service.
    """
    first, last = check_range(start, end)
    day = F.date_diff("usage_date", F.lit(first)).cast("decimal(10,0)")
    daily = (
        views.scoped(first, last)
        .metering.groupBy("service_type", "usage_date")
        .agg(F.sum("credits_used").alias("spent"))
        .where(F.col("spent").isNotNull())
        .select("service_type", day.alias("x"), F.col("spent").cast("decimal(27,9)").alias("y"))
    )
    x, y = F.col("x"), F.col("y")
    sums = daily.groupBy("service_type").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(x).cast("double").alias("sx"),
        F.sum(y).cast("double").alias("sy"),
        F.sum(x * y).cast("double").alias("sxy"),
        F.sum(x * x).cast("double").alias("sxx"),
    )
    n, sx, sy, sxy, sxx = (F.col(name) for name in ("n", "sx", "sy", "sxy", "sxx"))
    return sums.withColumn("slope", ratio(n * sxy - sx * sy, n * sxx - sx * sx)).withColumn(
        "intercept", (sy - F.col("slope") * sx) / n
    )


def cost_forecast(
    views: UsageViews, start: Day, end: Day, horizon: int = 38
) -> DataFrame:
    """Slope of each service's daily credits, and the line's value ``horizon`` days after start."""
    value = F.col("intercept") + F.col("slope") * F.lit(float(horizon))
    return _fits(views, start, end).select(
        "service_type",
        F.round("slope", 4).alias("slope"),
        F.round(value, 4).alias("projected_credits"),
    )


def cost_trend(
    views: UsageViews, start: Day, end: Day, threshold: float = 0.01
) -> DataFrame:
    """Whether each service's daily credits rise or fall; without a slope they are FLAT.

    The slope is held against the threshold before it is rounded.
    """
    direction = (
        F.when(F.col("slope") > threshold, "UP")
        .when(F.col("slope") < -threshold, "DOWN")
        .otherwise("FLAT")
    )
    return _fits(views, start, end).select(
        "service_type", F.round("slope", 4).alias("slope"), direction.alias("trend")
    )


def budget_scenarios(
    views: UsageViews,
    start: Day,
    end: Day,
    horizon: int = 38,
    scenarios: Mapping[str, float] = SCENARIOS,
) -> DataFrame:
    """The projected credits of all services under each scenario's factor."""
    cases = F.array(
        *(
            F.struct(F.lit(name).alias("scenario"), F.lit(float(factor)).alias("factor"))
            for name, factor in scenarios.items()
        )
    )
    projected = F.sum(F.col("projected_credits").cast("decimal(25,4)")).cast("double")
    return (
        cost_forecast(views, start, end, horizon)
        .agg(projected.alias("projected_credits"))
        .select(F.inline(cases), "projected_credits")
        .withColumn("budget_credits", F.round(F.col("projected_credits") * F.col("factor"), 4))
    )


def recommendations(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
    remote_spill_above: float = 0.05,
    failures_above: float = 0.25,
    spill_bytes_from: int = 20 * MIB,
) -> DataFrame:
    """What to look at: warehouses to enlarge, users whose queries fail, queries that spill.

    The shares of both kinds come from one pass that counts per warehouse and user first. Queries
    without a warehouse, a user or an id count in no subject of that kind.
    """
    scope = views.scoped(start, end, user, end_rule)
    counts = scope.queries.groupBy("warehouse_name", "user_name").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(spilled_remotely()).alias("spilled"),
        F.count_if(failed()).alias("failed"),
    )
    by_warehouse = F.grouping("user_name") == 1
    shares = counts.groupingSets(
        [["warehouse_name"], ["user_name"]], "warehouse_name", "user_name"
    ).agg(
        F.when(by_warehouse, "RIGHT_SIZE").otherwise("ERRORS").alias("rule"),
        F.when(by_warehouse, ratio(F.sum("spilled"), F.sum("rows")))
        .otherwise(ratio(F.sum("failed"), F.sum("rows")))
        .alias("evidence"),
    )
    limit = F.when(F.col("rule") == "RIGHT_SIZE", remote_spill_above).otherwise(failures_above)
    subject = F.coalesce("warehouse_name", "user_name")
    shares = shares.where((F.col("evidence") > limit) & subject.isNotNull()).select(
        "rule", subject.alias("subject"), "evidence"
    )
    large = (F.col(REMOTE) >= spill_bytes_from) & F.col("query_id").isNotNull()
    spill = scope.queries.where(large).select(
        F.lit("SPILL").alias("rule"),
        F.col("query_id").alias("subject"),
        F.col(REMOTE).cast("double").alias("evidence"),
    )
    return shares.unionByName(spill)


def recommendation_plan(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
    effort: Mapping[str, str] = EFFORT,
    **thresholds: float,
) -> DataFrame:
    """The recommendations in the order to take them: effort class, then place within the rule.

    Building it runs the job that numbers them and stores a copy (``session.remove_copies``).
    """
    numbered = number_rows(
        recommendations(views, start, end, user, end_rule, **thresholds),
        ["rule"],
        [F.col("evidence").desc(), F.col("subject").asc()],
        "position",
    )
    classes = F.create_map(*(F.lit(part) for pair in effort.items() for part in pair))
    places = F.create_map(*(F.lit(part) for pair in EFFORT_ORDER.items() for part in pair))
    return numbered.withColumn("effort", classes[F.col("rule")]).select(
        places[F.col("effort")].cast("bigint").alias("step"),
        "effort",
        "rule",
        "position",
        "subject",
        "evidence",
    )


def potential_savings(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
    fractions: Mapping[str, float] = SAVED_FRACTIONS,
    failures_above: float | None = None,
    spill_bytes_from: int | None = None,
) -> DataFrame:
    """Credits of failed queries and of queries that spilled, and the part that could be saved.

    By default every failed query and every spill counts. With the thresholds of
    ``recommendations``, only failed queries of users whose share of failures lies above
    ``failures_above`` and queries with that much remote spill do. A query under both rules counts
    in both, so the two rows must not be added up. Matching rows collapse to one row per query
    before the join.
    """
    scope = views.scoped(start, end, user, end_rule)
    queries = scope.queries
    rules = {"ERRORS": failed(), "SPILL": spilled()}
    if failures_above is not None:
        failing = failing_share(scope).where(
            (F.col("failure_share") > failures_above) & F.col("user_name").isNotNull()
        )
        failing = failing.select("user_name", F.lit(True).alias("_failing"))
        queries = queries.join(failing, "user_name", "left")
        rules["ERRORS"] = failed() & F.col("_failing").isNotNull()
    if spill_bytes_from is not None:
        rules["SPILL"] = F.col(REMOTE) >= spill_bytes_from
    matching = queries.where(rules["ERRORS"] | rules["SPILL"])
    matches = F.array_compact(
        F.array(*(F.when(condition, F.lit(rule)) for rule, condition in rules.items()))
    )
    share = F.create_map(*(F.lit(part) for pair in fractions.items() for part in pair))
    return (
        query_totals(matching, matches.alias("rules"))
        .join(scope.credits_of(matching), "query_id")
        .select(F.explode("rules").alias("rule"), times("query_rows", "credits").alias("spent"))
        .groupBy("rule")
        .agg(F.sum("spent").cast("double").alias("credits"))
        .withColumn("saved_credits", F.round(F.col("credits") * share[F.col("rule")], 4))
    )
