"""Parsers and models that this installation doesn't bring: registered by name, looked up when used."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

PROVIDERS: dict[str, Callable] = {}


def register(name: str, provider: Callable) -> None:
    """``pdf_pages``: bytes -> iterable of (page, text). ``vision``: (bytes, level) -> dict of caption, objects, ocr."""
    PROVIDERS[name] = provider


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page, text) of (path, content) by the registered PDF parser."""
    if "pdf_pages" not in PROVIDERS:
        raise LookupError("no PDF parser is registered")
    parse = PROVIDERS["pdf_pages"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, n, t) for p, c in zip(pdf["path"], pdf["content"]) for n, t in parse(bytes(c))], columns=["path", "page", "text"]).astype({"page": "int32"})

    return files.select("path", "content").mapInPandas(rows, "path string, page int, text string")
