"""filingscope: labor-certification filings analytics on Spark DataFrames.

Layers:
  functions/  Column expressions (name cleaning, tiering, wages, dates, flags)
  sources/    scans and sinks (raw CSV exports, master Parquet, test binding)
  operators/  DataFrame -> DataFrame operators (ingest, entities, search, stats, cube)
  plans/      composed flows (enrichment) and the query catalog with SQL oracles
  streaming/  incremental ingest of newly landed exports
"""

from filingscope.spec import LCA, PERM, FilingsSpec

__all__ = ["LCA", "PERM", "FilingsSpec"]
