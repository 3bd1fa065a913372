"""Queries over the test tables: views that shape them into facts, the registered queries, their SQL twins."""
