"""Operators: resume sections, fusion, projection, validation."""
