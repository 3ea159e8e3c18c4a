"""Readers and writers: raw inputs to typed tables, results to storage."""
