"""From raw documents to packed training sequences, one stage of the pixeltide.llm operators after the other.

Every stage reads the table the stage before it wrote and keeps whole texts:
language ID drops what has no letter, the quality classifier drops bad
documents, near-dedup keeps one document of each group, the secret scan masks
secrets, packing deals the rest into sequences. All but the last stage return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.llm import language, near_dedup, packing, quality, secrets
from pixeltide.llm.queries import BYTE_BPE, held_out, table
from pixeltide.llm.workers import on_workers
from pixeltide.sources.shared_folder import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Documents scored below this are dropped.
LEAST_QUALITY = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without any letter or text; ``lang`` becomes the predicted language.

    If nothing can be learned, as no row outside the held-out fifth has a text
    and a language, the same documents go and ``lang`` stays as it is.
    """
    on_workers(spark)
    samples = language.learn(docs.where(~held_out()))
    found = docs.withColumn("_found", language.predict(F.col("text"), samples)).where("_found.lettered")
    lang = F.col("_found.lang_pred") if samples else F.col("lang")
    return found.withColumn("lang", lang).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality."""
    field = quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return docs.where(quality.score(F.col("text"), field) >= LEAST_QUALITY).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates, and documents without id.

    Rows with one doc_id and one text are one document. Rows with one doc_id and
    different texts are documents of their own, so that no text goes unless a
    near-duplicate of its group stays; if they are in one group, the least text
    counts as the first.
    """
    on_workers(spark)
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    repeated = stored(repeated, "repeated")
    if not repeated.limit(1).count():
        gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # Ids that several rows share are replaced by a hash of id and text.
    again = F.col("_again").isNotNull()
    key = F.when(again, F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    keyed = docs.join(repeated.withColumn("_again", F.lit(True)), "doc_id", "left").withColumn("_key", key)
    keyed = stored(keyed, "keyed")
    groups = near_dedup.near_duplicates(keyed, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id")
    names = keyed.where("_key is not null").select("_key", F.struct("doc_id", F.when(again, F.col("text")), "_key").alias("name"))
    firsts = groups.distinct().join(names, "_key").groupBy("component_id").agg(F.min("name").alias("name"))
    left = keyed.join(firsts.select("name._key"), "_key", "left_semi")
    left = left.where(~again).unionByName(left.where(again).dropDuplicates(["doc_id", "text"]))
    return left.unionByName(keyed.where("_key is null")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a placeholder; ``n_chars`` is counted anew."""
    found = secrets.find_secrets(docs, into="_secrets")
    masked = found.withColumn("text", secrets.mask(F.col("text"), F.col("_secrets")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    on_workers(spark)
    return packing.pack(docs, BYTE_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: No stage but the secret scan can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
