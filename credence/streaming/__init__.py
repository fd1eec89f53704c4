"""Structured Streaming: incremental index, audits and event-time windows."""
