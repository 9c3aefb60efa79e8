"""Spark-first account-ledger analytics."""
