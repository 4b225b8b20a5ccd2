"""Lake tables, data quality, cleaning and enrichment as Spark DataFrame operators."""
