"""A training corpus from raw documents, in stages that each rewrite the table.

Every stage takes and returns the columns of ``documents``; the last returns
token ids. Rows without a key are judged like all others. Nothing but models,
word windows of the benchmark and checked lists of row numbers is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotsieve.llm import byte_bpe, ngram_jaccard, pii_boosting, quality_cnn, wu_manber
from glotsieve.llm.common import table
from glotsieve.llm.queries import QUALITY, byte_bpe_of
from glotsieve.session import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below the limit go; it learns from those given that have labels."""
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.score(docs, model, keep=COLUMNS[1:])
    return _columns(scored.filter(F.col("score") >= QUALITY))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the smallest id, rows without an id last.

    Rows are told apart by a settled number, so ids may repeat or be missing.
    Texts without words are no copies of one another and stay.
    """
    rows = settle(docs.select(F.monotonically_increasing_id().alias("_row"), *COLUMNS), "rows")
    member = ngram_jaccard.near_duplicates(rows, key="_row").select("_row", "component_id")
    member = settle(member.join(rows.select("_row", "doc_id"), "_row"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    leads = member.groupBy("component_id").agg(F.min(order)["_row"].alias("lead"), F.count("*").alias("rows"))
    leads = settle(leads.filter("rows > 1").select("component_id", "lead"), "leads")
    gone = member.join(_small(leads), "component_id").filter("_row <> lead")
    gone = settle(gone.select("_row"), "gone")
    return _columns(rows.join(_small(gone), "_row", "left_anti"))


def _small(ids: DataFrame) -> DataFrame:
    """Settled ids, broadcast up to a checked number."""
    most = ngram_jaccard.BROADCAST
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = wu_manber.benchmark_overlaps(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:], unnamed=True)
    return _columns(found.filter(F.size("spans") == 0))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; `n_chars` is that of the new text."""
    found = pii_boosting.personal_data(docs, pii_boosting.fit(docs), keep=COLUMNS[1:])
    text = pii_boosting.redact(F.col("text"), F.col("spans"))
    changed = F.size("spans") > 0
    return _columns(
        found.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
        .withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and a digest of the bytes they decode to."""
    coded = byte_bpe.encode_documents(docs, byte_bpe_of(spark))
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
