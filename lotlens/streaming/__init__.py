"""Structured Streaming: the registry of seen listings, rules that stop a crawl, and windows over events."""
