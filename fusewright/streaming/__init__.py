"""Streams of source profiles."""
