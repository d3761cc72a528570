"""All registered queries; importing the plan modules fills the registry."""

from __future__ import annotations

from tessera.plans import agents, answers, audits, dialogue, encyclopedia, evaluation, flows, generators, payloads, replies, retrieval, stores, training, verdicts  # noqa: F401
from tessera.plans.registry import QUERIES

__all__ = ["QUERIES"]
