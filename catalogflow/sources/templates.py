"""S6 template set: every .yaml/.yml file in a folder, name = file stem; a
file that does not parse (or lacks ``template``) is reported, not fatal;
a missing folder gives an empty set."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "template_name string, description string, template string, error string"


def load_templates(spark: SparkSession, folder: str) -> DataFrame:
    from .ledger import _exists
    if not _exists(spark, folder):
        return spark.createDataFrame([], SCHEMA)
    raw = (spark.read.option("pathGlobFilter", "*.{yaml,yml}")
           .text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value"))

    def run(batches):
        import yaml
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["value"]):
                name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    data = yaml.safe_load(text)
                    if not isinstance(data, dict) or "template" not in data:
                        raise ValueError("no 'template' key")
                    rows.append((name, data.get("description"), data["template"], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["template_name", "description", "template", "error"])

    return raw.mapInPandas(run, SCHEMA)


def template_map(templates: DataFrame) -> dict[str, str]:
    """Driver-side name -> template text (a handful of small rows)."""
    return {r.template_name: r.template for r in templates.where("error IS NULL").collect()}
