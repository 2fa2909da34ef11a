"""Structured Streaming: windows over events, running accumulators, incremental reading of documents."""
