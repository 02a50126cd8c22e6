"""Structured Streaming: sources, stateful processors and running topologies."""
