"""Chronoweave: a temporal memory graph on Spark DataFrames.

Episodes (raw content) become entities, facts and mentions, kept per group
and bi-temporally, and are searched, maintained and streamed with plain
DataFrame, SQL and Structured Streaming operators.
"""
