"""Contracts of what needs native image libraries or a network: rendering, deskewing, enhancement, OCR, codes, outside models.

A provider is a function that a Spark task calls per page image; the operators around it (choice of readings, mean
confidence, first useful code, egress policy) are in ``operators`` and ``functions`` and need no library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

READING = "filename string, page_no int, variant string, pos int, text string, n_lines int, conf double, skew double, blue_pixels bigint, codes array<string>, error string"


@dataclass
class Reading:
    """What a provider says about one variant of a page image."""

    variant: str = "plain"
    text: str = ""
    n_lines: int = 0
    conf: float = 0.0
    skew: float = 0.0
    blue_pixels: int = 0
    codes: list[str] = field(default_factory=list)


def read_pages(images: DataFrame, make_provider: Callable[[], Callable[[bytes], list[Reading]]]) -> DataFrame:
    """Readings of page images (filename, page_no, content). The provider is made once per task; a failure is a row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for batch in batches:
            rows = []
            for name, page, content in zip(batch["filename"], batch["page_no"], batch["content"], strict=True):
                try:
                    rows += [(name, page, r.variant, i, r.text, r.n_lines, r.conf, r.skew, r.blue_pixels, r.codes, None) for i, r in enumerate(provider(bytes(content)))]
                except Exception as problem:  # noqa: BLE001 - a provider is foreign code
                    rows.append((name, page, None, None, None, None, None, None, None, None, str(problem)))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in READING.split(", ")])
            yield frame.astype({"pos": "Int32", "n_lines": "Int32", "blue_pixels": "Int64"})

    return images.select("filename", "page_no", "content").mapInPandas(run, READING)


def send_with_retries(call: Callable[[], dict], attempts: int = 3) -> tuple[dict | None, int, str | None]:
    """(answer, attempts made, error) of an outside call; a client's helper, never used by default."""
    problem = None
    for n in range(1, attempts + 1):
        try:
            return call(), n, None
        except Exception as e:  # noqa: BLE001
            problem = str(e)
    return None, attempts, problem
