"""Streaming forms of the daily and hourly aggregations: an extension beyond the batch operators."""
