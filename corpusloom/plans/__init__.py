"""Registered queries."""

from . import documents, pages, registry, tables

__all__ = ["documents", "pages", "registry", "tables"]
