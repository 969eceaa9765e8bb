"""Structured Streaming forms of the run ledger and of incremental views."""
