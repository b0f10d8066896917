"""Registered queries of the operators: name -> function of (spark, folder), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (
    alignment, common, embedding_dedup, lm_scoring, minhash_dedup, mixing, pieces,
    quality_classifier, quality_rules, sharding, spelling, substring_dedup, token_counts, url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

#: Folder of the vocabulary files of public tokenizers.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that belongs to the byte-level vocabularies.
BYTE_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mix_sources")
def op1_mix_sources(spark, sf_dir):
    weight = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), F.col("source_rank") % 3 + 1)
    return mixing.mix(table(spark, sf_dir, "documents"), common.word_count(F.col("text")), weight)


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    return token_counts.token_table(
        table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_PATTERN
    )


#: Rules of the URL filter: verdict, host, start of the path.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@query("op9_filter_urls")
def op9_filter_urls(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _quality_sql() -> str:
    """The rules of ``quality_rules`` written as SQL."""
    names = list(quality_rules.MEASURES)
    bits = quality_rules.BITS
    drop = f"greatest(length(bin(value)) - {bits}, 0)"
    union = " union all ".join(
        f"select lang, source, '{m}' as measure, {m} as value from measured where n_words > 0"
        for m in names
    )

    def limits(name: str, by: str) -> str:
        room = "case measure " + " ".join(
            f"when '{m}' then {quality_rules.MEASURES[m][1]}" for m in names
        ) + " end"
        return f"""
        {name}_sums as (
            select {by}, measure, bucket,
                sum(sum(n)) over (partition by {by}, measure order by bucket) as upto,
                sum(sum(n)) over (partition by {by}, measure) as docs
            from sketch group by {by}, measure, bucket),
        {name}_q as (
            select {by}, measure, max(docs) as docs,
                min(case when upto * 4 >= docs then bucket end) as q1,
                min(case when upto * 4 >= docs * 3 then bucket end) as q3
            from {name}_sums group by {by}, measure),
        {name} as (
            select {by}, measure, docs,
                greatest(q1 - (q3 - q1) * {quality_rules.REACH} - {room}, 0) as low,
                q3 + (q3 - q1) * {quality_rules.REACH} + {room} as high
            from {name}_q)"""

    fails = " or ".join(
        f"(l.measure = '{m}' and (d.{m} > l.high" + (f" or d.{m} < l.low" if two else "") + "))"
        for m, (*_, two) in quality_rules.MEASURES.items()
    )
    return f"""
    with split as (
        select doc_id, lang, source, coalesce(text, '') as text, {WORDS_SQL} as w,
            list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
        from documents),
    places as (
        select doc_id, unnest(range(1, len(w) - 1)) as p, w from split where len(w) >= 3),
    windows as (select doc_id, p, w[p] as a, w[p + 1] as b, w[p + 2] as c from places),
    twice as (
        select doc_id, p, count(*) over (partition by doc_id, a, b, c) as n from windows),
    covered as (
        select doc_id, count(distinct q) as n_repeat_words
        from (select doc_id, unnest([p, p + 1, p + 2]) as q from twice where n > 1)
        group by doc_id),
    counts as (
        select s.doc_id, s.lang, s.source, cast(len(w) as bigint) as n_words,
            cast(length(array_to_string(w, '')) as bigint) as word_chars,
            cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
            cast(len(lines) as bigint) as n_lines,
            cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
            cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
            cast(length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) as bigint) as n_capitals
        from split s left join covered c using (doc_id)),
    measured as (
        select *,
            case when n_words > 0 then greatest(n_symbols - {quality_rules.MEASURES['symbol_share'][0]}, 0) * 10000 // n_words else 0 end as symbol_share,
            case when n_lines > 0 then greatest(n_dup_lines - {quality_rules.MEASURES['dup_line_share'][0]}, 0) * 10000 // n_lines else 0 end as dup_line_share,
            case when n_words > 0 then greatest(n_repeat_words - {quality_rules.MEASURES['repeat_share'][0]}, 0) * 10000 // n_words else 0 end as repeat_share,
            case when word_chars > 0 then greatest(n_capitals - {quality_rules.MEASURES['capital_share'][0]}, 0) * 10000 // word_chars else 0 end as capital_share,
            case when n_words > 0 then word_chars * 100 // n_words else 0 end as word_length
        from counts),
    sketch as (
        select lang, source, measure, (value >> {drop}) << {drop} as bucket, count(*) as n
        from ({union}) group by all),
    {limits("fine", "lang, source")},
    {limits("coarse", "lang")},
    chosen as (
        select f.lang, f.source, f.measure,
            (f.docs * f.low + {quality_rules.PRIOR} * c.low) // (f.docs + {quality_rules.PRIOR}) as low,
            (f.docs * f.high + {quality_rules.PRIOR} * c.high) // (f.docs + {quality_rules.PRIOR}) as high
        from fine f join coarse c on f.lang is not distinct from c.lang and f.measure = c.measure),
    judged as (
        select d.doc_id, bool_or(coalesce({fails}, false)) as beyond
        from measured d left join chosen l
            on d.lang is not distinct from l.lang and d.source is not distinct from l.source
        group by d.doc_id)
    select d.doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
        n_capitals, symbol_share, dup_line_share, repeat_share, capital_share, word_length,
        n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed,
        not (n_words < 50 or n_repeat_words * 100 > n_words * 50) and not beyond as kept
    from measured d join judged using (doc_id)"""


@query("op7_quality_rules", _quality_sql())
def op7_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query(
    "op8_substring_dedup",
    f"""
    with split as (select doc_id, {WORDS_SQL} as w from documents),
    places as (select doc_id, unnest(range(1, len(w) - 48)) as p from split where len(w) >= 50),
    windows as (
        select p.doc_id, p, hash(array_to_string(w[p:p + 49], ' ')) as h,
            md5(array_to_string(w[p:p + 49], ' ')) as m
        from places p join split using (doc_id)),
    firsts as (
        select doc_id, p, min(doc_id) over (partition by h, m) as first from windows),
    gone as (
        select distinct doc_id, unnest(range(p, p + 50)) as q from firsts where first < doc_id),
    tokens as (select doc_id, unnest(range(1, len(w) + 1)) as q, unnest(w) as word from split),
    kept as (
        select doc_id, count(*) as n, string_agg(word, ' ' order by q) as kept_text
        from tokens anti join gone using (doc_id, q) group by doc_id)
    select doc_id, cast(len(w) as bigint) as n_words,
        cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
        sha256(coalesce(kept_text, '')) as kept_sha256
    from split left join kept using (doc_id)""",
)
def op8_substring_dedup(spark, sf_dir):
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


@query(
    "op6_embedding_dedup",
    """
    with recursive good as (
        select vec_id, label, cast(embedding as double[]) as v from embeddings
        where label is not null and embedding is not null and vec_id is not null
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
            and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (
        select a.vec_id as a, b.vec_id as b from good a join good b
            on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
            and list_cosine_similarity(a.v, b.v) >= 0.93),
    reach as (
        select a as vec_id, a as root from links
        union select l.b, r.root from reach r join links l on l.a = r.vec_id),
    roots as (select vec_id, min(root) as root from reach group by vec_id)
    select e.vec_id, coalesce(n, 0) as n_links, coalesce(root, e.vec_id) as component_id,
        e.vec_id = coalesce(root, e.vec_id) as kept
    from embeddings e
    left join roots r on e.vec_id = r.vec_id
    left join (select a, count(*) as n from links group by a) l on e.vec_id = l.a""",
)
def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_minhash_dedup")
def op5_minhash_dedup(spark, sf_dir):
    found = minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "kept")


@query("op2_quality_classifier")
def op2_quality_classifier(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_classifier.classify(table(spark, sf_dir, "documents"), trusted).drop("row_key")


@query("op10_sentencepiece")
def op10_sentencepiece(spark, sf_dir):
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pieces.encode(docs, model).withColumn("copy", F.col("ids"))
    decoded = pieces.decode(rows, model, ids="copy")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


@query("op11_sharding")
def op11_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark, sf_dir):
    return alignment.align_documents(
        table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", BYTE_PATTERN,
        f"{TOKENIZERS}/piece_bpe_32k.model",
    )
