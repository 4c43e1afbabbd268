"""A training corpus from raw documents, in stages over the whole table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. Documents go that are in no learnt language, that
are toxic, that copy another one or that hold benchmark passages; the last stage
encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvitals.llm import bpe, decontaminate, langid, minhash, toxicity
from fleetvitals.llm.queries import TOKENIZERS, table
from fleetvitals.llm.text import restricted
from fleetvitals.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Below it no language has the larger part of the probability.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages; null and letterless texts go.

    The score only compares the learnt languages, so a text must also be as short in the
    code of its language as texts held back from learning are, within `langid.limits`:
    twice their middle bits a byte or more. A close relative of a learnt language may stay.
    """
    model = langid.fit(docs, hold_back=True)
    found = langid.judged(docs, model, keep=COLUMNS)
    found = found.where((F.col("lang_pred") != langid.NONE)
                        & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    limits = langid.limits(docs, model)
    if limits:
        bound = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang_pred")]
        bound += langid.allowance(F.col("n_bytes"))
        found = found.where(F.col("bits") <= bound * F.col("n_bytes"))
    return found.select(*COLUMNS)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic."""
    model = stored(toxicity.fit(docs, table(spark, sf_dir, "labels")), "toxic-weights")
    return toxicity.scored(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key that only rows of the same id and text share; ids may be null
    or stand in several rows."""
    return docs.withColumn("key", minhash.row_key(F.col("doc_id"), F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates: that of the smallest doc_id, rows without
    id last, and of several texts of one id that of the smallest key.

    Of rows equal in id and text the first by n_chars, lang and source stays. Texts without
    words are in no group; of them, rows equal in id and text are kept once.
    """
    found = minhash.near_duplicates(docs).select(
        "doc_id", F.coalesce("group_id", "row_key").alias("group_id"),
        F.col("group_id").isNull().alias("alone"), F.col("row_key").alias("key"))
    each = found.groupBy("alone", "group_id", "doc_id", "key").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "rows")).alias("first")
    kept = stored(each.groupBy("alone", "group_id").agg(first).select("first.key", "first.rows"), "kept")
    rows = keyed(docs)
    # Only keys that stand in several rows need those rows side by side.
    single = restricted(rows, kept.where("rows = 1").select("key"), "key")
    repeated = restricted(rows, kept.where("rows > 1").select("key"), "key")
    once = repeated.groupBy("doc_id", "text").agg(
        F.min(F.struct("n_chars", "lang", "source")).alias("rest")).select("doc_id", "text", "rest.*")
    return single.select(*COLUMNS).unionByName(once.select(*COLUMNS))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a benchmark window, each row judged by its own text."""
    rows = keyed(docs)
    hits = decontaminate.benchmark_hits(rows, table(spark, sf_dir, "benchmark"), "key")
    hit = stored(hits.where(F.size("runs") > 0).select(F.col("doc_id").alias("key")).distinct(),
                 "contaminated")
    return restricted(rows, hit, "key", "left_anti").select(*COLUMNS)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of every document, and of the decoded text."""
    return bpe.round_trips(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_filter),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_free),
    ("bpe", bpe_ids),
]
# Learnt models and tokenizer rules cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
