"""Point tables: schemas, validation, and views over Parquet tables."""
