"""Imports every module that registers queries."""

from lakeloom.plans import queries_bank, queries_models, queries_scorecard, queries_tables  # noqa: F401
