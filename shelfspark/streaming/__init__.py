"""Structured Streaming forms of the statement triggers and state machines (M3-M7)."""
