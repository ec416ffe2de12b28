"""Media-delivery analytics on Spark: manifests and media become tables, checks become queries."""
