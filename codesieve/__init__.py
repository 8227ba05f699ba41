"""Fast text-predicate analytics on Spark: compact integer codes of strings that prune scans, and what surrounds them."""
