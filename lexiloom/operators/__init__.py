"""Operators on collections of byte strings, as functions from DataFrame to DataFrame."""
