"""Spark-native analytics for bank ledgers, call records and sessions."""
