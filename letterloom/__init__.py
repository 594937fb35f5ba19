"""Analysis of official correspondence and similar text collections as Spark DataFrame operations."""
