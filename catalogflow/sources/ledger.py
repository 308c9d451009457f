"""Tolerant ledger source -- a missing or empty path gives an empty
ledger, corrupt JSON lines are kept aside in ``_corrupt_record``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("strategy", T.StringType()),
    T.StructField("product_type", T.StringType()),
    T.StructField("score_before", T.IntegerType()),
    T.StructField("score_after", T.IntegerType()),
    T.StructField("delta", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("rows_read", T.IntegerType()),
])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


# Field names of the original ledger file (JSON array), in
# record order, and the logical names they map to
ORIGINAL_FIELDS = {"estrategia_aplicada": "strategy", "tipo_de_produto": "product_type",
                   "texto_original_score": "score_before", "novo_texto_score": "score_after",
                   "melhora_score": "delta", "timestamp": "ts", "quantidade_lida": "rows_read"}


def read_ledger(spark: SparkSession, path: str, fmt: str = "json", keep_corrupt: bool = False) -> DataFrame:
    """Read the ledger; absent path -> empty DataFrame with the ledger schema.

    fmt ``json``: JSON lines (what ``append_ledger`` writes); each line is
    parsed with built-in functions, lines that hold no JSON object go to ``_corrupt_record``
    (dropped unless ``keep_corrupt``).  ``parquet``: appended Parquet parts,
    schemas merged by name, extra columns kept.  ``json_array``: the original single-file JSON
    array with its original field names (``seq`` is the array position)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    if fmt == "parquet":
        df = spark.read.option("mergeSchema", "true").parquet(path)
        missing = [f for f in LEDGER_SCHEMA.fields if f.name not in df.columns]
        return df.select(*[F.col(f.name) if f not in missing else F.lit(None).cast(f.dataType).alias(f.name)
                           for f in LEDGER_SCHEMA.fields], *[c for c in df.columns if c not in LEDGER_SCHEMA.fieldNames()])
    if fmt == "json_array":
        orig = T.StructType([T.StructField(k, LEDGER_SCHEMA[v].dataType) for k, v in ORIGINAL_FIELDS.items()])
        df = spark.read.schema(orig).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        df = df.select(*[F.col(k).alias(v) for k, v in ORIGINAL_FIELDS.items()])
        return df.withColumn("seq", F.monotonically_increasing_id()).select(*LEDGER_SCHEMA.fieldNames())
    raw = spark.read.text(path)
    # a record is a JSON object; numbers, strings, null and arrays are not
    ok = F.try_parse_json(F.col("value")).isNotNull() & F.col("value").rlike(r"^\s*\{")
    parsed = raw.select(F.when(ok, F.from_json("value", LEDGER_SCHEMA)).alias("_r"),
                        F.when(~ok, F.col("value")).alias("_corrupt_record"))
    out = parsed.select("_r.*", "_corrupt_record")
    if keep_corrupt:
        return out
    return out.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
