"""ledgerloom: a PySpark-native engine for auditable record pipelines."""
