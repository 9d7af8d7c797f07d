"""Writers: CSV, JSON, Parquet and incremental exports."""
