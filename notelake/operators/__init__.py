"""Relational operators over DataFrames of notes, items, tags, links and logs."""
