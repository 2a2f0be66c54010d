"""Readers of files, archives, staged CSV, shards, JDBC tables and catalog metadata."""
