"""Whole crawl computations made of operators."""
