"""Relational operators over frames whose column names are unique and case-sensitive."""
