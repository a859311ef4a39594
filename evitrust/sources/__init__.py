"""Typed readers, deterministic sinks and the run manifest."""
