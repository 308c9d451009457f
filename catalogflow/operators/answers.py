"""Keyed store of model answers: one answer per prompt, whatever happened before.

Rows are (``prompt_hash``, ``response``, ``run``, ``wave``), appended under one
folder of the shared file system.  A prompt's answer is the first one given:
least ``run``, then ``wave``, then the least text; null answers (failed calls)
count only where there is no other, and such prompts are asked again by the next
run.  Prompts are asked once each, in waves that commit as they end: what a lost
driver leaves unasked is at most one wave, and the next run asks only that.
"""

from __future__ import annotations

from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

SCHEMA = "prompt_hash string, response string, run long, wave long"
ORDER = ("run", "wave")


def prompt_hash(prompt) -> Column:
    """A prompt's key: SHA-256 of its text (null for a null prompt)."""
    return F.sha2(F.col(prompt) if isinstance(prompt, str) else prompt, 256)


def one_answer(responses: DataFrame, order: tuple[str, ...] | None = None) -> DataFrame:
    """(prompt_hash, response): one row per hash.  Of several answers the first
    by ``order`` (default: ``run`` and ``wave`` where the table has them), then by
    text; null answers come last.  A partial aggregate: repeats are reduced
    before they are shuffled."""
    order = tuple(c for c in ORDER if c in responses.columns) if order is None else order
    by = F.struct(F.col("response").isNull().alias("_none"), *order, "response")
    return responses.where(F.col("prompt_hash").isNotNull()).groupBy("prompt_hash").agg(F.min_by("response", by).alias("response"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class AnswerStore:
    """Answers under ``path``.  Several runs may share a store; concurrent runs
    may ask the same prompt twice but never lose or mix answers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        """Everything that was ever answered (an empty table for a new store)."""
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def answers(self) -> DataFrame:
        """(prompt_hash, response), one row per hash."""
        return one_answer(self.rows())

    def add(self, answers: DataFrame, run: int = 0, wave: int = 0) -> None:
        """Appends given answers (``prompt_hash``, ``response``)."""
        answers.select("prompt_hash", "response", F.lit(run).cast("long").alias("run"), F.lit(wave).cast("long").alias("wave")) \
            .write.mode("append").parquet(self.path)

    def unanswered(self, prompts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        """(prompt_hash, prompt): the distinct prompts that have no answer yet."""
        asked = prompts.where(F.col(prompt_col).isNotNull()).select(prompt_hash(prompt_col).alias("prompt_hash"), F.col(prompt_col).alias("prompt"))
        asked = asked.groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
        return asked.join(self.answers().where("response is not null"), "prompt_hash", "left_anti")

    def ask(self, prompts: DataFrame, prompt_col: str, client_factory: Callable[[], Callable[[list], list]],
            parallelism: int, batch_size: int = 16, wave_size: int | None = None) -> int:
        """Asks what is unanswered and returns how many prompts that were.

        ``parallelism`` tasks call the model at a time, each with a client of its
        own.  ``wave_size`` prompts (default: 64 batches per caller) are asked per
        committed append."""
        todo = materialize(self.unanswered(prompts, prompt_col), "unanswered")
        n = todo.count()
        if not n:
            return 0
        size = wave_size or parallelism * batch_size * 64
        waves = -(-n // size)
        run = (self.rows().agg(F.max("run")).first()[0] or 0) + 1
        if waves > 1:       # laid out by wave, so that a wave reads its own prompts only
            path = scratch_path(self.spark, "waves")
            todo.withColumn("wave", F.pmod(F.xxhash64("prompt_hash"), F.lit(waves))).repartition("wave").write.partitionBy("wave").parquet(path)
            todo = self.spark.read.schema("prompt_hash string, prompt string, wave long").parquet(path)
        else:
            todo = todo.withColumn("wave", F.lit(0).cast("long"))

        def call(batches: Iterable[pd.DataFrame]):
            client = client_factory()
            for pdf in batches:
                texts, got = pdf["prompt"].tolist(), []
                for at in range(0, len(texts), batch_size):
                    got += client(texts[at:at + batch_size])
                yield pd.DataFrame({"prompt_hash": pdf["prompt_hash"], "response": pd.Series(got, index=pdf.index, dtype=object)})

        for wave in range(waves):
            part = todo.where(F.col("wave") == wave).repartition(parallelism, "prompt_hash")
            self.add(part.select("prompt_hash", "prompt").mapInPandas(call, "prompt_hash string, response string"), run, wave)
        return n
