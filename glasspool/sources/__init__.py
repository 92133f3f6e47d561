"""Readers and writers: Parquet snapshots, delimited dumps, JDBC, node documents, address lists."""
