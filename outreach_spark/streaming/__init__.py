"""Structured Streaming: event and reply ingestion.

Every transformation here is a DataFrame -> DataFrame function that runs unchanged on a batch
DataFrame (used by the registered queries and the batch = stream tests) or a streaming one.
"""
