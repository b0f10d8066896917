"""Rules that ordinary data does not reach: times after the as-of time, retries, missing names,
messages without a time, checks over no rows, models that fail."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.functions.mask import redact_error
from parlance.operators import (
    conversations, diagnostics, platform_metrics, quality, runs, scoring, sentiment,
)
from parlance.streaming import events

AS_OF = datetime(2024, 1, 30, 12)


@pytest.fixture(scope="module")
def log(spark):
    hours = (-24 * 61, -24 * 40, -30, -23, -5, -1, 0, 1, 10)
    rows = [
        (f"d{i}", AS_OF + timedelta(hours=h), "j", "r", "t", f"{'  ' * i}boom", "success", 1.0, 2.0)
        for i, h in enumerate(hours)
    ]
    df = spark.createDataFrame(
        rows,
        "id string, timestamp timestamp, job_id string, run_id string, failed_task string, "
        "error_message string, status string, duration_seconds double, estimated_cost_usd double",
    )
    return df.withColumns(
        {"error_hash": F.lit("h"), "provider": F.lit("p"), "model": F.lit("m"),
         "input_tokens": F.lit(1), "output_tokens": F.lit(1), "pr_number": F.lit(0),
         "pr_url": F.lit(""), "branch_name": F.lit(""), "confidence": F.lit(1.0),
         "job_name": F.lit("")}
    )


def test_nothing_after_the_as_of_time_counts(log):
    now = F.lit(AS_OF)
    names = lambda df: sorted(r["id"] for r in df.collect())
    assert names(diagnostics.recent_successes(log, now)) == ["d3", "d4", "d5", "d6"]
    assert names(diagnostics.recent_successes(log, now, newest=2)) == ["d5", "d6"]
    assert sum(r["diagnosticos"] for r in diagnostics.diagnoses_per_day(log, now).collect()) == 5
    assert diagnostics.cost_per_model(log, now).first()["chamadas"] == 5
    assert diagnostics.cumulative_cost(log, now).agg(F.max("custo_acumulado_usd")).first()[0] == 12.0
    assert tuple(diagnostics.cost_alert(log, now).first()) == (8.0, True)
    assert diagnostics.cost_alert(log.filter("id <> 'd3' and id <> 'd4'"), now).first()["alerta"] is False
    assert diagnostics.failure_alert(log.withColumn("status", F.when(F.col("id") > "d6", "llm_failed").otherwise("success")), now).first()[0] == 0
    assert diagnostics.repeated_error_alert(log, now).count() == 0
    assert diagnostics.repeated_error_alert(log, now, more_than=2).first()["repeticoes"] == 3
    errors = log.select("error_message").limit(1)
    later = log.filter("id > 'd6'").withColumn("error_hash", diagnostics.error_hash(F.col("error_message")))
    assert not diagnostics.duplicate_decision(errors, later, now).first()["is_duplicate"]


def test_one_error_is_one_row_with_its_whole_text(log):
    row = diagnostics.frequent_errors(log.withColumn("error_message", F.lit("x" * 300))).collect()
    assert len(row) == 1 and len(row[0]["erro_resumo"]) == 300 and row[0]["ocorrencias"] == 9


def test_errors_are_not_cut(one_column):
    assert one_column(["y" * 900], redact_error) == ["y" * 900]
    assert one_column(["y" * 900], lambda c: redact_error(c, 500)) == ["y" * 500]


RUN = "job_id string, job_name string, run_id string, start_time long, result_state string, run_duration long, tasks array<struct<task_key:string,result_state:string,error:string>>"


def test_failures_behind_good_runs_are_found(spark):
    now = int((AS_OF - datetime(1970, 1, 1)).total_seconds() * 1000)
    rows = [("j", "n", f"bad{i}", now - 600_000 + i, "FAILED", 1, [("t", "FAILED", "e")]) for i in range(3)]
    rows += [("j", "n", f"good{i}", now - 100_000 + i, "SUCCESS", 1, [("t", "SUCCESS", None)]) for i in range(7)]
    rows += [("j", "n", "later", now + 1, "FAILED", 1, [("t", "FAILED", "e")])]
    df = spark.createDataFrame(rows, RUN)
    assert sorted(r["run_id"] for r in runs.recent_failures(df, F.lit(AS_OF)).collect()) == ["bad0", "bad1", "bad2"]
    assert [r["run_id"] for r in runs.recent_failures(df, F.lit(AS_OF), newest=1).collect()] == ["bad2"]


def test_retried_and_unnamed_tasks(spark):
    tasks = [("a", "FAILED", "e"), (None, "SUCCESS", None), ("a", "SUCCESS", None), ("b", None, None)]
    df = spark.createDataFrame([("j", "n", "r", 0, "SUCCESS", 1, tasks)], RUN)
    assert runs.pipeline_summary(df).first()["tasks"] == {"a": "SUCCESS", "b": "UNKNOWN", "unknown": "SUCCESS"}


def test_instances_without_a_channel(spark):
    rows = [(1, None, "connected"), (1, "wa", "closed"), (1, None, None)]
    df = spark.createDataFrame(rows, "company_id int, channel string, state string")
    row = platform_metrics.channel_metrics(df).first()
    assert row["by_channel"] == {"wa": 1, "unknown": 2} and (row["total"], row["connected"]) == (3, 1)


def test_a_message_without_a_time_is_not_the_first(spark):
    rows = [("c", None, "m0", "old"), ("c", AS_OF, "m2", "first"), ("c", AS_OF + timedelta(1), "m1", "last"),
            ("d", None, "m4", "b"), ("d", None, "m3", "a")]
    df = spark.createDataFrame(rows, "conversation_id string, timestamp timestamp, message_id string, body string")
    first = F.min_by("body", conversations.message_order())
    got = {r[0]: r[1] for r in df.groupBy("conversation_id").agg(first).collect()}
    assert got == {"c": "first", "d": "a"}


def test_an_unmeasured_check_does_not_pass(spark):
    empty = spark.createDataFrame([], "conversation_id string, message_body string")
    checks = quality.run_checks({"bronze": empty, "messages": empty})
    passed = {r["check"]: r["passed"] for r in checks.collect()}
    assert passed["lead_score_range"] is None and passed["silver_ratio_error"] is None
    result = quality.verdict(checks).first()
    assert result["status"] == "FAIL" and "lead_score_range" in result["unmeasured"]
    assert {"funil_vendas", "fatal_messages"} <= set(quality.GOLD_TABLES) and len(quality.GOLD_TABLES) == 17


def test_model_in_batches(spark):
    calls = []

    def factory():
        def model(texts):
            if any("fail" in t for t in texts):
                raise ValueError
            return [{"POS": 1.0 if "otimo" in t else 0.0, "NEG": 0.0, "NEU": 0.5} for t in texts]

        return model

    rows = [("c", AS_OF, f"m{i}", "inbound", t, "o") for i, t in enumerate(["n" * 600 + " otimo", "fail", "ok ok", "x"])]
    df = spark.createDataFrame(rows, "conversation_id string, timestamp timestamp, message_id string, direction string, message_body string, conversation_outcome string")
    row = sentiment.model_sentiment(df, factory, "v").first()
    assert (row["sentiment_score"], row["failed_count"], row["positive_count"], row["inbound_messages"]) == (0.25, 1, 1, 4)
    assert not calls


def test_scoring_scheme_can_change(spark):
    row = (20, 0.5, True, False, None, 59.0, 1, 9)
    df = spark.createDataFrame([row], "inbound_count int, sentiment_score double, has_cpf boolean, has_email boolean, has_plate boolean, avg_response_time_sec double, business_hours_messages int, total_messages int")
    got = scoring.with_score(df).first()
    assert (got["raw_score"], got["lead_score"], got["score_tier"]) == (30 + 15 + 8 + 15 + 5 + 5, 78, "hot")
    own = scoring.Scheme(flags={"has_cpf": 50}, tiers=((90, "best"),), lowest_tier="rest")
    assert tuple(scoring.with_score(df, own).select("lead_score", "score_tier").first()) == (100, "best")


def stream_of(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, tmp_path):
    sink = str(tmp_path / "out")
    events.write_available(df, sink, str(tmp_path / "cp")).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(sink)


def test_markers_close_all_sessions(spark, tmp_path):
    rows = [(f"c{i % 3}", AS_OF + timedelta(hours=3 * (i // 6))) for i in range(24)]
    df = spark.createDataFrame(rows, "conversation_id string, timestamp timestamp")
    end = spark.createDataFrame([(None, AS_OF + timedelta(365))], df.schema)
    stream = stream_of(spark, df, str(tmp_path / "a"))
    marker = stream_of(spark, end.limit(0), str(tmp_path / "b"))
    closed = events.sessions(events.closed_by(stream, marker))
    assert drained(closed, tmp_path).agg(F.sum("messages")).first()[0] < 24
    end.write.mode("append").parquet(str(tmp_path / "b"))  # once the source is used up
    got = drained(closed, tmp_path)
    assert got.agg(F.sum("messages")).first()[0] == 24 and got.count() == 12


def test_an_event_that_comes_days_late_stays(spark, tmp_path):
    schema = "id string, received_at timestamp"
    path = str(tmp_path / "in")
    for part in ([("a", AS_OF)], [("b", AS_OF - timedelta(3)), ("a", AS_OF)]):
        stream = stream_of(spark, spark.createDataFrame(part, schema).coalesce(1), path)
    got = drained(events.dedup_stream(stream), tmp_path)
    assert sorted(r["id"] for r in got.collect()) == ["a", "b"]
