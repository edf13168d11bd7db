"""Tidewatch: emerging-topic analytics as DataFrame, SQL and Structured Streaming plans."""
