"""All registered queries."""

from __future__ import annotations

from pagelens.checks import asking, retrieval, text, upkeep

CHECKS = {**text.CHECKS, **upkeep.CHECKS, **retrieval.CHECKS, **asking.CHECKS}
