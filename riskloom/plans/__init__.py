"""The operators applied to the given tables, each with the SQL that says the same."""

from __future__ import annotations

from riskloom.plans import encoding, features, modelling, quality, scoring
from riskloom.plans.plan import Plan

PLANS: dict[str, Plan] = {
    **quality.PLANS,
    **features.PLANS,
    **encoding.PLANS,
    **modelling.PLANS,
    **scoring.PLANS,
}

__all__ = ["PLANS", "Plan"]
