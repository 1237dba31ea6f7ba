"""Imports every module that registers queries."""

from scholium.queries import catalogue, domain, gates, retrieval, revisions, rows, services  # noqa: F401
