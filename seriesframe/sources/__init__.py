"""CSV and parquet sources, stages and calendar spines."""
