"""Catalogue of ready queries."""
