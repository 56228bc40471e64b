"""Where tables come from: the session catalog, or a folder of Parquet tables."""
