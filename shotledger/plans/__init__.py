"""Registered queries and their SQL."""

from shotledger.plans import edits, reports, rollups, scores, shots, texts  # noqa: F401
from shotledger.plans.base import ORACLE, QUERIES  # noqa: F401
