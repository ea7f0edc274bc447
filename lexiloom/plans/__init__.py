"""Helpers that plans share: scratch tables and global row numbers."""
