"""Imports every query module so that they register themselves."""

import importlib

from catalog.registry import ORACLES, QUERIES

for _name in ("text_queries", "section_queries", "routing_queries", "relation_queries", "document_queries"):
    importlib.import_module(f"catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
