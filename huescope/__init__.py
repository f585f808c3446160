"""Colour-contrast auditing of archived web pages as Spark DataFrame jobs."""
