"""tidemark: analytics over content-addressed artifact catalogs, as Spark plans."""
