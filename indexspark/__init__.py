"""indexspark: composite-indicator scoring as Spark DataFrame plans.

Sub-packages:
  functions  -- null-semantics column helpers (R-compatible NA rules) and scalar helpers
  sources    -- layer store, catalog-driven CSV ingest, driver-table readers, proxy layers
  operators  -- reusable DataFrame operators (filters, joins, aggregates, windows, reshape)
  plans      -- goal jobs, composites, hierarchy, extensions, quality reports, query catalog

"""

__version__ = "0.1.0"
