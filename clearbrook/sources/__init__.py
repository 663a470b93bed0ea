"""Sources and sinks: CSV, XLSX, Parquet."""
