"""Operators that prepare training data: deduplication, scans, filters, mixing and sharding.

Nothing outside this subpackage imports it; ``catalog`` holds its queries and their SQL.
"""
