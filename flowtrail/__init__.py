"""Rule evaluation and traffic analytics over recorded tables, on Spark."""
