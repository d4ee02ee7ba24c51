"""trialforge: a PySpark-native analytics engine for append-only experiment logs."""
