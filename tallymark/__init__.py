"""Reconciliation, data quality, ETL building blocks and run analytics on Spark."""
