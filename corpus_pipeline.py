"""From raw documents to token ids in five stages, each one operator of ``parlance.llm``.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of
``documents``; the last one returns token ids. Other columns of ``docs`` are carried along.

In every stage: a null id counts as larger than any other; null and empty texts are texts without a
word; rows equal in id and text are decided alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import minhash_dedup, mixing, pieces, quality_classifier, substring_dedup
from parlance.llm.common import stored, word_count

#: Vocabulary of the last stage; weights of the sources, by code point, repeating.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WEIGHTS = (3, 1, 2)
#: SQL cannot express the classifier, the near-duplicate groups, the mix or the encoding.
ORACLE_SQL = None


def _order() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(minhash_dedup.NO_ID))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, _order, _key): the row, its id (null as the largest number), a hash of its text."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("doc"), _order().alias("_order"), F.xxhash64("text").alias("_key"))


def _chosen(docs: DataFrame, rows: DataFrame, most: int | None = None) -> DataFrame:
    """Documents as often as ``rows`` (_order, _key, copies) say, at most ``most`` times. Rows equal
    in id and text are one document with the sum of their copies."""
    copies = F.sum("copies") if most is None else F.least(F.sum("copies"), F.lit(most))
    per_row = rows.groupBy("_order", "_key").agg(copies.alias("_copies"), F.count("*").alias("_n"))
    per_row = stored(per_row, "chosen-rows")
    found = _keyed(docs).join(per_row.where("_copies > 0"), ["_order", "_key"])
    if per_row.where("_n > 1").limit(1).count():
        found = found.dropDuplicates(["_order", "_key"])
    if per_row.where("_copies > 1").limit(1).count():
        found = found.withColumn("_copy", F.explode(F.expr("sequence(1, cast(_copies as int))")))
    return found.select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language. An empty input stays empty."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    judged = quality_classifier.classify(docs, trusted).where("not kept")
    rejected = judged.select(_order().alias("_order"), F.col("row_key").alias("_key")).distinct()
    return _keyed(docs).join(rejected, ["_order", "_key"], "left_anti").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id. Of rows equal in id
    and text one stays. Texts without a word, null or empty, are duplicates of nothing and stay."""
    found = minhash_dedup.near_duplicates(docs)
    rows = found.select(
        _order().alias("_order"), F.col("row_key").alias("_key"), F.col("kept").cast("int").alias("copies")
    )
    return _chosen(docs, rows, most=1)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a document of smaller id holds too;
    documents of which nothing is left go. ``n_chars`` follows the text. Texts of which nothing is
    removed stay as they are, null ones too; rows equal in id and text stay alike, as neither has the
    smaller id."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).dropFields("text")
    found = substring_dedup.remove_repeats(
        docs.select("doc_id", "text", rest.alias("rest")), keep=("rest",), untouched=True
    ).where("n_removed = 0 or n_removed < n_words")
    size = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("rest.n_chars"))
    new = {"text": F.col("kept_text"), "n_chars": size.cast("long")}
    return found.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 3, 1, 2, repeating, and share 150%
    of all words; a document comes up to twice. Texts without a word come once for each whole round
    over their source; rows equal in id and text together as often as the mix takes them."""
    weight = F.element_at(
        F.array(*[F.lit(w) for w in WEIGHTS]), F.col("source_rank") % len(WEIGHTS) + 1
    )
    row = F.struct(_order().alias("order"), F.xxhash64("text").alias("key"))
    taken = mixing.mix(
        docs.select(row.alias("row"), "source", "text"), word_count(F.col("text")), weight, id_col="row"
    )
    rows = taken.select(F.col("doc_id.order").alias("_order"), F.col("doc_id.key").alias("_key"), "copies")
    return _chosen(docs, rows)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the whole text, their number, and whether decoding gives
    the text again, for every row. Null and empty texts have no ids; decoding them gives ''."""
    rows = pieces.encode(docs.select("doc_id", "lang", "source", "text"), MODEL)
    rows = pieces.decode(rows.withColumn("_ids", F.col("ids")), MODEL, ids="_ids")
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return rows.select(
        "doc_id", "lang", "source", "ids", F.size("ids").alias("n_pieces"), same.alias("round_trip")
    )


STAGES = [
    ("quality", quality), ("near_dedup", near_dedup), ("substring", substring), ("mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
