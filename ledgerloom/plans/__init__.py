"""Whole plans and the catalogue of queries."""
