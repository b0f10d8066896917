"""Quality gates over the Bronze, Silver and Gold tables.

The checks are conditions on a few numbers of each table. The numbers are observed while a table is
read or written anyway, or taken from a scan of it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parlance.functions.fixed_values import CPF_PUNCTUATED
from parlance.functions.regex import unicode

GOLD_TABLES = (
    "agent_performance", "campaign_geo", "campaign_roi", "churn_reengagement",
    "competitor_intel", "email_providers", "fatal_messages", "fcr_summary",
    "first_contact_resolution", "funil_vendas", "lead_scoring", "negotiation_by_outcome", "negotiation_complexity", "persona_summary",
    "personas", "sentiment", "temporal_analysis",
)
MASKED_COLUMNS = ("cpf_masked", "email_masked", "phone_masked", "plate_masked")


@dataclass(frozen=True)
class Thresholds:
    min_silver_rows: int = 1000
    error_ratio: float = 0.01
    warning_ratio: float = 0.03


def metrics_of(name: str) -> dict[str, Column]:
    """What is measured of a table."""
    extra = {
        "messages": {
            # few texts have the dash, which the pattern needs
            "clear_cpf": F.count_if(
                F.col("message_body").contains("-") & F.col("message_body").rlike(unicode(CPF_PUNCTUATED))
            )
        },
        "lead_scoring": {"low": F.min("lead_score"), "high": F.max("lead_score")},
        "sentiment": {"low": F.min("sentiment_score"), "high": F.max("sentiment_score")},
        "bronze": {"null_conversation": F.count_if(F.col("conversation_id").isNull())},
    }
    return {"rows": F.count(F.lit(1)), **extra.get(name, {})}


def measure(df: DataFrame, name: str) -> DataFrame:
    """Row count and further aggregates of one table, as (metric, value) rows, by a scan."""
    aggregates = metrics_of(name)
    row = df.agg(*[a.cast("double").alias(metric) for metric, a in aggregates.items()])
    pairs = [
        F.struct(F.lit(f"{name}.{metric}").alias("metric"), F.col(metric).alias("value"))
        for metric in aggregates
    ]
    return row.select(F.inline(F.array(*pairs)))


def measure_all(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """The numbers of all tables that exist."""
    measured = [measure(df, name) for name, df in tables.items() if df is not None]
    return reduce(DataFrame.unionAll, measured)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df``, and its numbers, which are there when the first job that uses it is done. They come
    with that job: nothing is read for them. Tasks that are run again because an executor was lost
    may count twice; ``measure`` has numbers that cannot."""
    watch = Observation(name)
    return df.observe(watch, *[a.cast("double").alias(m) for m, a in metrics_of(name).items()]), watch


def numbers_of(spark: SparkSession, watches: Mapping[str, Observation]) -> DataFrame:
    """(metric, value) rows of observations that are done: a few dozen numbers."""
    rows = [(f"{name}.{m}", v) for name, watch in watches.items() for m, v in watch.get.items()]
    return spark.createDataFrame(rows, "metric string, value double")


def run_checks(
    tables: Mapping[str, DataFrame | None],
    thresholds: Thresholds = Thresholds(),
    expected_columns: Mapping[str, list[str]] | None = None,
    numbers: DataFrame | None = None,
) -> DataFrame:
    """One row per check: check, layer, severity, value, threshold, passed.

    ``numbers`` are those observed while the tables were written; without them the tables are scanned.

    ``passed`` is NULL for a check that could not be measured, such as a range over no rows.

    ``tables`` maps ``bronze``, ``messages``, ``leads_profile``, ``conversations`` and the Gold
    table names to DataFrames; one that is absent or None fails its existence check.
    ``expected_columns`` flags columns beyond the listed ones.
    """
    if not any(df is not None for df in tables.values()):
        raise ValueError("no table to check")
    layer_of = {"bronze": "bronze", "messages": "silver", "leads_profile": "silver",
                "conversations": "silver"}
    numbers = measure_all(tables) if numbers is None else numbers
    wanted = [
        f"{name}.{metric}"
        for name, metrics in {
            **{name: ["rows"] for name in (*layer_of, *GOLD_TABLES)},
            "bronze": ["rows", "null_conversation"],
            "messages": ["rows", "clear_cpf"],
            "lead_scoring": ["rows", "low", "high"],
            "sentiment": ["rows", "low", "high"],
        }.items()
        for metric in metrics
    ]
    # a few dozen metric rows become one row
    facts = numbers.agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in wanted]
    )

    def n(metric: str) -> Column:
        return F.col(f"`{metric}`")

    def check(name, layer, severity, value, threshold, passed) -> Column:
        return F.struct(
            F.lit(name).alias("check"),
            F.lit(layer).alias("layer"),
            F.lit(severity).alias("severity"),
            value.cast("double").alias("value"),
            F.lit(threshold).cast("double").alias("threshold"),
            passed.alias("passed"),
        )

    def constant(value: bool) -> Column:
        return F.lit(value)

    def exists(name: str) -> bool:
        return tables.get(name) is not None

    bronze, silver = n("bronze.rows"), n("messages.rows")
    ratio = F.try_divide(silver, bronze)
    limit = thresholds
    checks = [
        check("bronze_not_empty", "bronze", "error", bronze, 1, bronze > 0),
        check(
            "bronze_conversation_id", "bronze", "error", n("bronze.null_conversation"), 0,
            n("bronze.null_conversation") == 0,
        ),
        check("dedup_effect", "silver", "warning", silver - bronze, 0, silver < bronze),
        check(
            "silver_volume", "silver", "error", silver, limit.min_silver_rows,
            silver >= limit.min_silver_rows,
        ),
        check(
            "silver_ratio_error", "silver", "error", ratio, limit.error_ratio,
            ratio >= limit.error_ratio,
        ),
        check(
            "silver_ratio_warning", "silver", "warning", ratio, limit.warning_ratio,
            (ratio >= limit.warning_ratio) | (ratio < limit.error_ratio),
        ),
        check(
            "clear_cpf", "silver", "error", n("messages.clear_cpf"), 0,
            n("messages.clear_cpf") == 0,
        ),
        check(
            "lead_score_range", "gold", "error", n("lead_scoring.high"), 100,
            (n("lead_scoring.low") >= 0) & (n("lead_scoring.high") <= 100),
        ),
        check(
            "sentiment_range", "gold", "error", n("sentiment.high"), 1,
            (n("sentiment.low") >= -1) & (n("sentiment.high") <= 1),
        ),
    ]
    for name in (*layer_of, *GOLD_TABLES):
        checks.append(
            check(
                f"{name}_exists", layer_of.get(name, "gold"), "error",
                F.lit(float(exists(name))), 1, constant(exists(name)),
            )
        )
    for name in GOLD_TABLES:
        checks.append(
            check(f"{name}_not_empty", "gold", "warning", n(f"{name}.rows"), 1,
                  n(f"{name}.rows") > 0)
        )
    if exists("leads_profile"):
        missing = sorted(set(MASKED_COLUMNS) - set(tables["leads_profile"].columns))
        checks.append(
            check("masked_columns", "silver", "error", F.lit(len(missing)), 0,
                  constant(not missing))
        )
    for name, columns in (expected_columns or {}).items():
        if exists(name):
            extra = set(tables[name].columns) - set(columns)
            checks.append(
                check(f"{name}_unexpected_columns", layer_of.get(name, "gold"), "error",
                      F.lit(len(extra)), 0, constant(not extra))
            )
    return facts.select(F.inline(F.array(*checks)))


def zero_denominators(df: DataFrame, column: str) -> DataFrame:
    """Rows whose denominator is 0 or missing, before a rate divides by it."""
    return df.agg(
        F.count_if(F.col(column) == 0).alias("zero"),
        F.count_if(F.col(column).isNull()).alias("missing"),
    )


def verdict(checks: DataFrame) -> DataFrame:
    """PASS if every error check passed, else FAIL, with the failed checks by severity and the
    checks that could not be measured; an unmeasured error check fails the verdict."""

    def failed(severity: str) -> Column:
        names = F.when(~F.col("passed") & (F.col("severity") == severity), F.col("check"))
        return F.array_sort(F.collect_list(names))

    unmeasured = F.when(F.col("passed").isNull(), F.col("check"))
    open_errors = F.count_if(F.col("passed").isNull() & (F.col("severity") == "error"))
    return checks.agg(
        failed("error").alias("errors"),
        failed("warning").alias("warnings"),
        F.array_sort(F.collect_list(unmeasured)).alias("unmeasured"),
        open_errors.alias("_open"),
    ).select(
        F.when((F.size("errors") == 0) & (F.col("_open") == 0), "PASS").otherwise("FAIL").alias(
            "status"
        ),
        "errors",
        "warnings",
        "unmeasured",
    )


def require_pass(checks: DataFrame) -> None:
    """Raises ValueError with the failed error checks."""
    result = verdict(checks).first()
    if result["status"] != "PASS":
        names = [*result["errors"], *result["unmeasured"]]
        raise ValueError(f"{len(names)} failed or unmeasured checks: {', '.join(names)}")
