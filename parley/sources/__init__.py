"""Landing files in, parquet tables out."""
