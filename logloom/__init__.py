"""Log analytics as Spark DataFrame transforms: ingest shaping, stream queries,
correlation, fingerprints, quotas, alerts, change data and statistics."""
