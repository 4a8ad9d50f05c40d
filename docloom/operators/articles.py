"""Main articles of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.functions.article import article


def articles(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, content) of each page's (key, html) main article as markdown; content is null where nothing readable is left.

    A null page and one that can't be parsed have neither title nor content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(1).to_pylist():
                try:
                    rows.append(article(page) if page is not None else (None, None))
                except Exception:  # noqa: BLE001  a broken page has no article
                    rows.append((None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in (0, 1))], [key, "title", "content"])

    return pages.select(key, "html").mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, title string, content string")
