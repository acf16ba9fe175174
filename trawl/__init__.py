"""trawl — keyword search over document and web-page corpora, as Spark DataFrame jobs.

Submodules:
  functions  Column-expression building blocks (text folding, match counts, snippets,
             HTML text/links, URL normalisation and classification).
  operators  DataFrame -> DataFrame jobs (line grep, page grep, dedup, link graph,
             BFS traversal, fetch outcomes, statistics).
  sources    Readers (binaryFile folders, parquet tables, derived fixture views).
  plans      End-to-end compositions (folder scan, crawl-and-grep) and report sinks.
  streaming  Structured Streaming variants.
"""

from trawl.params import SearchParams  # noqa: F401
