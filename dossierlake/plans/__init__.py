"""Registered queries, each with the SQL that checks it."""

from dossierlake.plans.registry import all_oracles, all_queries  # noqa: F401
