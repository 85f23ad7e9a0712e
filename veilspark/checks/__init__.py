"""Queries over the given tables that exercise every operator, each with the same computation as
plain SQL where SQL can express it."""

from __future__ import annotations

from . import budgeting, encoding, evaluation, generating, keys, learning, modelling, reading, sampling, wholes
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "budgeting", "encoding", "evaluation", "generating", "keys", "learning",
           "modelling", "reading", "sampling", "wholes"]
