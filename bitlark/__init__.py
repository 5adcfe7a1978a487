"""Exact top-k search over bit-packed codes, on Spark."""
