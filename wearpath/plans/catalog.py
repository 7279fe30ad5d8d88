"""Importing this module registers every query."""

from . import aggregates, checks, components, detectors, ingest, jobs, models, partitions, relations, requests, scores, stores, streams, texts, windows  # noqa: F401
from .registry import BUILDERS, SQL  # noqa: F401
