"""Readers and writers: everything goes through Spark's own sources, so any store that Spark reads works."""
