"""Operators for large-scale training-data pipelines (quality, WARC, token
counts, near-duplicates, mixing, language ID, URL lists, sampling, line dedup).

Nothing outside this subpackage, ``corpus_pipeline.py`` and the driver entry
imports it."""
