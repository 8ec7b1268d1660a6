"""Registered queries over the driver tables, and the SQL each is checked against."""

from __future__ import annotations

from lodestone.registry import basics, ingested, knowledge, lifecycle, pipelines, retrieval

_FAMILIES = (basics, retrieval, knowledge, lifecycle, ingested, pipelines)


def queries():
    return {name: fn for family in _FAMILIES for name, fn in family.QUERIES.items()}


def sql():
    return {name: text for family in _FAMILIES for name, text in family.SQL.items()}
