"""Structured Streaming: discovery, state machines, outbox and release windows."""
