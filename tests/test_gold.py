import pytest
from pyspark.sql import functions as F

from parlance.functions.mask import HashKey
from parlance.operators import (
    agents, campaigns, contacts, conversations, facts, funnel, leads, negotiation, scoring,
    sentiment, silence,
)
from parlance.plans.medallion import build_gold, build_silver, store_silver
from workload import derived

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def silver(spark, tmp_path_factory):
    stored = store_silver(
        build_silver(derived.bronze(spark, SMALL)), str(tmp_path_factory.mktemp("silver"))
    )
    return stored


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_facts_equal_the_single_tables(silver):
    clean = silver.messages
    assert rows(silver.conversations) == rows(conversations.enrich_conversations(clean))
    assert rows(silver.sentiment) == rows(sentiment.keyword_sentiment(clean))
    assert rows(silver.signals) == rows(leads.lead_signals(clean))


def test_gold_from_stored_tables_equals_gold_from_facts(silver):
    gold = build_gold(silver)
    convs, mood, signals = silver.conversations, silver.sentiment, silver.signals
    scores = scoring.lead_scoring(convs, mood, signals)
    assert rows(gold["lead_scoring"]) == rows(scores)
    assert rows(gold["personas"]) == rows(scoring.personas(convs, mood, scores, signals))
    assert rows(gold["campaign_roi"]) == rows(campaigns.campaign_roi(convs, scores))
    resolved = contacts.first_contact_resolution(contacts.contact_sequence(signals, convs))
    assert rows(gold["first_contact_resolution"]) == rows(resolved)
    joined = funnel.outcome_distribution(convs).join(
        funnel.abandonment_point(silver.messages, convs), "outcome", "left"
    )
    assert rows(gold["funil_vendas"]) == rows(joined)


def test_facts_do_not_depend_on_partitions(silver):
    one = facts.conversation_facts(silver.messages.repartition(1)).drop("_first_inbound")
    many = facts.conversation_facts(silver.messages.repartition(7)).drop("_first_inbound")
    digits = [F.round(c, 9).alias(c) if t == "double" else c for c, t in one.dtypes]
    assert rows(one.select(*digits)) == rows(many.select(*digits))


def test_signals_from_profile(spark, silver):
    key = HashKey.prepare(spark, "k")
    from_profile = leads.signals_from_profile(silver.profile(key))
    assert rows(from_profile) == rows(silver.signals)


MESSAGE = (
    "conversation_id string, timestamp timestamp, message_id string, direction string, "
    "message_body string, sender_name_normalized string, sender_phone string, "
    "conversation_outcome string"
)


def talk(spark, *bodies, conversation="c"):
    lines = [
        (conversation, f"2024-01-01 00:00:{i:02d}", f"m{i:02d}", "inbound", body, f"n{i}", f"p{i}", "x")
        for i, body in enumerate(bodies)
    ]
    untyped = MESSAGE.replace("timestamp timestamp", "timestamp string")
    return spark.createDataFrame(lines, untyped).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp")
    )


def test_profile_counts_an_entity_once_per_array(spark):
    key = HashKey.prepare(spark, "k")
    df = talk(spark, "", "a@x.com", "a@x.com", "a@x.com b@x.com")
    row = leads.leads_profile(df, key).first()
    assert row["email_masked"] == ["*@x.com", "*@x.com", "*@x.com"]
    assert (row["lead_name"], row["lead_phone"]) == ("n1", "p1")
    assert row["cpf_hash"] == [] and row["prices_mentioned"] == []
    assert len(leads.leads_profile(df, key, distinct=True).first()["email_masked"]) == 2
    assert leads.entity_mentions(df, "emails").count() == 3
    assert leads.entity_mentions(df, "emails", distinct=True).count() == 2


def test_large_profile_is_one_row_without_loss(spark):
    key = HashKey.prepare(spark, "k")
    df = talk(spark, *[f"mail u{i:03d}x@x.com" for i in range(50)]).unionByName(
        talk(spark, "oi", conversation=None)
    )
    whole = leads.leads_profile(df, key)
    assert whole.count() == 2 and whole.select(F.explode("email_masked")).count() == 50
    assert whole.filter("lead_name is not null").count() == 2
    same = talk(spark, *[f"000.000.001-91 u{i:03d}x@x.com" for i in range(10)])
    once = leads.leads_profile(same, key, distinct=True).collect()
    assert len(once) == 1 and len(set(once[0]["cpf_hash"])) == len(once[0]["cpf_hash"])


def test_strict_profile_and_signals(spark):
    key = HashKey.prepare(spark, "k")
    df = talk(spark, "cep 08617-986").withColumn("sender_phone", F.lit("+55 11 98765-4321"))
    row = leads.leads_profile(df, key, strict=True).first()
    assert row["ceps"] == ["08617-***"] and row["lead_phone"] == "(55) ****-4321"
    assert len(leads.lead_signals(df, strict=True, key=key).first()["lead_phone"]) == 16
    with pytest.raises(ValueError):
        leads.lead_signals(df, strict=True)


def test_sentiment_words(spark):
    df = talk(spark, "TOPA muito bom", "caro demorado", "nada", "muito bom")
    row = sentiment.keyword_sentiment(df).first()
    assert (row["total_positive"], row["total_negative"], row["inbound_messages"]) == (1, 2, 4)
    assert row["sentiment_score"] == -0.333 and row["sentiment_label"] == "negativo"
    phrases = sentiment.keyword_sentiment(df, phrase=True).first()
    assert phrases["total_positive"] == 3
    silent = sentiment.keyword_sentiment(talk(spark, "nada", "")).first()
    assert silent["sentiment_score"] == 0.0 and silent["sentiment_label"] == "neutro"


def faulty_model():
    """Factory that is pickled by value, so that workers need not find this file."""

    def build():
        def predict(texts):
            if any("falha" in text for text in texts):
                raise RuntimeError("cannot read")
            return [{"POS": 0.7, "NEG": 0.1, "NEU": 0.2} for _ in texts]

        return predict

    return build


def test_model_sentiment(spark):
    df = talk(spark, "gostei " * 200, "falha", "oi", "bom dia")
    scored = {r["message_body"][:5]: r["ml_sentiment_score"] for r in
              sentiment.score_messages(df, faulty_model()).collect()}
    assert scored == {"goste": 0.6, "falha": 0.0, "oi": 0.0, "bom d": 0.6}
    sizes = lambda: lambda texts: [{"POS": len(t) / 10_000} for t in texts]
    whole = sentiment.score_messages(df, sizes).agg(F.max("ml_sentiment_score")).first()[0]
    assert whole == 0.14
    row = sentiment.model_sentiment(df, faulty_model(), "v").first()
    assert row["positive_count"] == 2 and row["sentiment_label"] == "positivo"
    assert row["failed_count"] == 1


def scored_row(spark, **values):
    base = dict(
        conversation_id="c", outcome="x", campaign_id="k", agent_id="a", inbound_count=0,
        sentiment_score=0.0, has_cpf=False, has_email=False, has_plate=False, has_competitor=False,
        avg_response_time_sec=700.0, business_hours_messages=0, total_messages=1,
    )
    row = {**base, **values}
    schema = (
        "conversation_id string, outcome string, campaign_id string, agent_id string, "
        "inbound_count bigint, sentiment_score double, has_cpf boolean, has_email boolean, "
        "has_plate boolean, has_competitor boolean, avg_response_time_sec double, "
        "business_hours_messages bigint, total_messages bigint"
    )
    df = spark.createDataFrame([tuple(row[f.split()[0]] for f in schema.split(", "))], schema)
    return scoring.with_persona(scoring.with_score(df)).first()


def test_lead_score(spark):
    low = scored_row(spark)
    assert (low["lead_score"], low["score_tier"]) == (10, "cold")
    best = scored_row(
        spark, inbound_count=10, sentiment_score=1.0, has_cpf=True, has_email=True, has_plate=True,
        avg_response_time_sec=59.0, business_hours_messages=1, total_messages=16,
    )
    assert (best["lead_score"], best["score_tier"]) == (100, "hot")
    assert scored_row(spark, avg_response_time_sec=None)["lead_score"] == 10
    assert scored_row(spark, has_cpf=None)["lead_score"] == 10
    empty = scored_row(spark, sentiment_score=None)
    assert (empty["lead_score"], empty["score_tier"]) == (0, "cold")


@pytest.mark.parametrize(
    "values, name",
    [
        (dict(total_messages=5, outcome="venda_fechada", has_competitor=True), "decidido_rapido"),
        (dict(has_competitor=True, outcome="perdido_preco"), "comparador_preco"),
        (dict(total_messages=15, outcome="em_negociacao"), "engajado_indeciso"),
        (dict(inbound_count=3, outcome="ghosting", has_cpf=True, sentiment_score=1.0), "ghost"),
        (dict(has_cpf=True, sentiment_score=0.1, outcome=None), "lead_quente"),
        (dict(outcome="desistencia_lead"), "curioso"),
        (dict(outcome=None), "indefinido"),
    ],
)
def test_personas(spark, values, name):
    assert scored_row(spark, **values)["persona"] == name


def test_email_providers(spark):
    mails = ["*@gmail.com", "*@acme.com", "*@me.com", "*@hotmail.com", None, "sem-arroba"]
    df = spark.createDataFrame([(m,) for m in mails], "email_masked string")
    found = {r["provider"]: (r["provider_category"], r["pct_of_total"]) for r in
             campaigns.email_providers(df).collect()}
    assert found["acme.com"] == ("Apple", 20.0) and found["gmail.com"][0] == "Gmail"
    assert found[None] == ("Outros", 20.0)
    exact = {r["provider"]: r["provider_category"] for r in
             campaigns.email_providers(df, exact=True).collect()}
    assert exact["acme.com"] == "Outros" and exact["me.com"] == "Apple"


def test_reengaged_is_null_without_outcome(spark):
    df = talk(spark, "a", "b").withColumn("conversation_outcome", F.lit(None).cast("string"))
    later = df.withColumn(
        "timestamp",
        F.when(F.col("message_id") == "m01", F.expr("timestamp + interval 3 hours")).otherwise(
            F.col("timestamp")
        ),
    )
    row = silence.churn_summary(silence.silence_gaps(later)).first()
    assert row["churn_events"] == 1 and row["was_reengaged"] is None


def test_negotiation(spark):
    df = talk(spark, "qual o VALOR?", "a cobertura", "", None)
    row = negotiation.negotiation_complexity(df).first()
    assert tuple(row)[1:] == (1, 1, 1, 3, "x", 0.333)


def test_agent_rates(silver):
    found = agents.agent_performance(silver.conversations)
    bad = found.filter("win_rate > 100 or win_rate_percentile not between 0 and 100")
    assert found.count() > 1 and bad.count() == 0
