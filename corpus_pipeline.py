"""The corpus pipeline: documents -> toxicity -> near duplicates -> repeated passages -> mix -> packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and
reads again for the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideatlas.llm import common, mixing, neardup, packing, substring, toxicity


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """Further columns of the documents travel through a stage in one struct, so their names clash with nothing."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names, own = docs.columns, [c for c in docs.columns if c in COLUMNS]
        extra = {c: f"f{i}" for i, c in enumerate(c for c in names if c not in COLUMNS)}
        if not extra:
            return stage(spark, docs, sf_dir)
        packed = docs.select(*own, F.struct(*[F.col(common.quoted(c)).alias(f) for c, f in extra.items()]).alias("extra_columns"))
        return stage(spark, packed, sf_dir).select(*[F.col(f"extra_columns.{extra[c]}").alias(c) if c in extra else F.col(c) for c in names])

    run_stage.__doc__ = stage.__doc__
    return run_stage


@apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go. Null and empty texts score like texts without words; rows
    without an id are judged like others and learned from never; repeated rows go or stay together; without labels nothing
    goes; an empty table stays empty."""
    judged = toxicity.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where(~F.col("rejected")).select(*docs.columns)


@apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id. Rows that share an id are one
    document: of them the smallest text stays, once. Null and empty texts link with nothing and stay, once for each id; rows
    without an id stay all; an empty table stays empty."""
    kept = neardup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    rows = docs.join(kept, "doc_id").withColumn("nth", first).where("nth = 1").select(*docs.columns)
    return rows.unionByName(docs.where("doc_id IS NULL"))


@apart
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; a text that loses none stays as it was, and so do null, empty and short ones. A document
    that loses all its words stays as an empty text; repeated rows lose what they share; n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring.substring_dedup(docs, carry=tuple(rest))
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars")) if "n_chars" in rest else None}
    return out.select(*[(new[c] if c in new else F.col(f"carried.{c}") if c in rest else F.col(c)).alias(c) for c in docs.columns])


@apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, range-sorted by training position. Texts without words are never taken; null
    is a source of its own; repeated rows are taken each by itself; an empty table stays empty."""
    return mixing.mixed(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids. A null or empty text is its end id alone; repeated rows are packed each
    by itself; further columns of the documents end here; an empty table gives no piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), packing.Settings(keep_ids=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("curriculum_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained network and a tokenizer take part, so SQL has no twin; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences. What a stage wrote is removed once the next one is written; the last stage's files, in the folder
    corpus-<run>, are the result and stay."""
    common.checkpoint_ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            common.removed(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
