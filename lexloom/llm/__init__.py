"""Operators on the text of a training-data pipeline. Nothing outside this package imports it."""

import importlib

_MODULES = ["corpus_queries", "name_queries", "page_queries", "text_queries"]


def query_modules() -> list:
    return [importlib.import_module(f"lexloom.llm.{m}") for m in _MODULES]
