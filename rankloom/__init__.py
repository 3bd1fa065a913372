"""Competitive search and link analytics expressed as Spark DataFrame jobs."""
