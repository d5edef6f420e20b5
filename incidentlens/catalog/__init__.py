"""Registered queries, one or more per operator."""

from __future__ import annotations

from . import cards, cleaning, geography, models, risk, statistics  # noqa: F401
from .registry import CHECKS, QUERIES


def queries():
    return dict(QUERIES)


def checks():
    return dict(CHECKS)
