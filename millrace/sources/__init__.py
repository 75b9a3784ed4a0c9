"""Readers for what a script's FROM can name."""
