"""Readers and writers; a table is a folder of files, one row per record."""
