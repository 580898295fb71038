"""Registered queries over the library's own operators, and their SQL."""

from corploom.plans import cleaning, curation, fields, io
from corploom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cleaning", "curation", "fields", "io"]
