"""Queries by name and their SQL."""

from __future__ import annotations

from textloom.plans import structural, textual, trees

QUERIES = {k: f for m in (textual, structural, trees) for k, (f, _) in m.REGISTERED.items()}
ORACLES: dict[str, str] = {k: s for m in (textual, structural, trees) for k, (_, s) in m.REGISTERED.items() if s}
