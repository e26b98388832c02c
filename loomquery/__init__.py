"""A Spark-native, read-only analytics engine: SQL dialect front end, column functions and relations."""
