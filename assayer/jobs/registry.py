"""All reference queries with their oracle SQL."""

from __future__ import annotations

from assayer.jobs import aggregates, answers, archives, composites, detectors, messages, relational, repair, replays, reports, similarity, star, statistics, streams, texts, transforms, variants  # noqa: F401  the job modules register their queries
from assayer.jobs.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
