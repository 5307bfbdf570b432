"""Operators over reads, coverage segments, regions and intervals."""
