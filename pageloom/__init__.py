"""Typed findings and crawl analytics over tables or streams of captured web pages."""

from pageloom.operators.registry import Registry, default_registry
from pageloom.plans.pipeline import extract_all, page_items, page_results
from pageloom.sources.pages import read_pages

__all__ = [
    "Registry",
    "default_registry",
    "extract_all",
    "page_items",
    "page_results",
    "read_pages",
]
