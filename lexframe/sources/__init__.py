"""Where tables come from: schemas, seed rows and the adapter over star-schema Parquet tables."""
