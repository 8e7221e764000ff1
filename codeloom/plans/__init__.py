"""Whole jobs: build, search, and the queries of the driver contract."""
