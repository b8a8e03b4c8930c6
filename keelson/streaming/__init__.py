"""Structured Streaming forms of the monitoring and ledger jobs."""
