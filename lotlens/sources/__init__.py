"""Readers and parsers of raw inputs."""
