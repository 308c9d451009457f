"""catalogflow: catalog-content enrichment and quality jobs as Spark DataFrame operators.

Sub-packages:
  sources    readers (sheets, workbooks, request payloads, leaflet pages, ledger, templates)
  sinks      writers (draft / approved / rejected exports, ledger append, base64 payloads)
  functions  Column -> Column helpers (keys, HTML, JSON extraction, prompt rendering)
  operators  DataFrame -> DataFrame operators (enrichment, merges, scorers, ledger, review, events)
  plans      compositions (content pipeline, batch draft, review set, finalise, reprocess)
  streaming  Structured Streaming versions of the event-frame operators
"""

__version__ = "0.1.0"
