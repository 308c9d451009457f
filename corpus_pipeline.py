"""The corpus pipeline: five stages over the documents table.

Every stage takes what its predecessor kept, written as Parquet and reread; all
but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogflow.llm import langid, minhash, mixing, sampling, templates
from catalogflow.llm.common import materialize, table

PIECES = "piece_bpe_32k.model"
ORACLE_SQL = None  # language models, MinHash and sampling have no SQL form


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars (where there is one) that of the new text."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def language(spark, docs, sf_dir):
    """Drops documents whose language is rejected: without letters, or written
    like none of the languages learnt."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit(docs.where(part != 2))
    return docs.where(~langid.predict(docs, model)["rejected"])


def lines(spark, docs, sf_dir):
    """Takes out lines whose template recurs; the first document keeps them.  A
    document goes only if another keeps each of its lines word for word."""
    return _sized(templates.without_copies(docs), docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return minhash.one_of_each(docs)


def mix(spark, docs, sf_dir):
    """The sources at their target weights: a row per pass over a document."""
    return _sized(mixing.mixed_texts(docs), docs.columns)


def pieces(spark, docs, sf_dir):
    """Sampled piece ids of every text of the mix."""
    import public_tokenizers
    out = sampling.sampled(docs, public_tokenizers.path(PIECES))
    return out.select(
        F.col("key").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.element_at("samples", 1)["ids"].alias("ids"),
        F.transform("samples", lambda s: F.size(s["ids"]).cast("long")).alias("n_pieces"),
        F.transform("samples", lambda s: s["inclusion"]).alias("inclusion"),
        sampling.restored(F.col("text"), F.col("decoded")).alias("round_trip"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("source_mix", mix), ("sentencepiece", pieces)]


def run(spark, sf_dir):
    """Applies the stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
