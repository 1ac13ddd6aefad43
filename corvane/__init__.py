"""Context analytics over text, code and history tables on Spark."""
