"""Bulk auditing of hospital claims and search over rule documents, on Spark."""
