"""Listing catalogues and batch recommendations as Spark DataFrame jobs."""
