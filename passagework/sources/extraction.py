"""Pages and figures out of PDF files, through a parser that is given.

No parser is part of this package. ``extract`` takes a function from a file's
bytes to its page texts; ``render`` one to its figures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

PAGES = "manual_id string, ord long, page int, text string, error string"
FIGURES = "manual_id string, page int, n int, width int, height int, jpeg binary, error string"


def _frames(rows: Iterator[tuple], columns: list[str], kinds: dict[str, str], size: Callable[[tuple], int], most: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Rows in frames of about ``most`` bytes, so that neither a small row costs a frame of its own nor a large file is held whole."""
    held: list[tuple] = []
    n = 0
    for row in rows:
        held.append(row)
        n += 100 + size(row)
        if n >= most:
            yield pd.DataFrame(held, columns=columns).astype(kinds)
            held, n = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns).astype(kinds)


def extract(files: DataFrame, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """(manual_id, ord, page, text, error) of files (manual_id, content). A file that fails is one row with its error."""

    def rows_of(frame: pd.DataFrame) -> Iterator[tuple]:
        for manual, content in zip(frame["manual_id"], frame["content"], strict=True):
            try:
                rows = [(manual, i, i + 1, text, None) for i, text in enumerate(parse(content))]
            except Exception as e:  # noqa: BLE001 - whatever a parser raises concerns one file
                rows = [(manual, None, None, None, str(e) or type(e).__name__)]
            yield from rows

    def pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _frames(rows_of(frame), ["manual_id", "ord", "page", "text", "error"], {"ord": "Int64", "page": "Int32"}, lambda r: 4 * len(r[3] or ""))

    return files.select("manual_id", "content").mapInPandas(pages, PAGES)


def render(files: DataFrame, draw: Callable[[bytes], Iterator[tuple[int, int, Callable[[], tuple[bytes, int, int]]]]]) -> DataFrame:
    """Figures of files: draw gives (page, n, how to render it). One that can't be rendered is a row with its error."""

    def rows_of(frame: pd.DataFrame) -> Iterator[tuple]:
        for manual, content in zip(frame["manual_id"], frame["content"], strict=True):
            for page, n, paint in draw(content):
                try:
                    jpeg, width, height = paint()
                    yield manual, page, n, width, height, jpeg, None
                except Exception as e:  # noqa: BLE001 - one figure must not cost the others
                    yield manual, page, n, None, None, None, str(e) or type(e).__name__

    def figures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _frames(rows_of(frame), ["manual_id", "page", "n", "width", "height", "jpeg", "error"], {"width": "Int32", "height": "Int32"}, lambda r: len(r[5] or b""))

    return files.select("manual_id", "content").mapInPandas(figures, FIGURES)
