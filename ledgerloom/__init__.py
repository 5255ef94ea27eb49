"""Ledger analytics as PySpark DataFrame jobs."""
