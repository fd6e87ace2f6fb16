"""PDF scan into positioned spans. The parser is optional: without pdfplumber the scan refuses, and spans may come from any table of the same columns."""

from __future__ import annotations

import io
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from marlstone.sources.files import Limits

SPANS = "path string, span_index int, text string, x0 double, y0 double, x1 double, y1 double, page int, font_size double, bold boolean, italic boolean, font_name string"


def available() -> bool:
    try:
        import pdfplumber  # noqa: F401
    except ImportError:
        return False
    return True


def pdf_spans(files: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """SPANS of files (path, content): upright glyphs in words, y growing downwards. A file beyond its pages or seconds, or without text, raises with its path."""
    if not available():
        raise RuntimeError("pdfplumber is not installed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pdfplumber

        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                out, began = [], time.monotonic()
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    if len(pdf.pages) > limits.max_pages:
                        raise ValueError(f"{path}: too many pages")
                    for n, page in enumerate(pdf.pages, 1):
                        if time.monotonic() - began > limits.seconds:
                            raise TimeoutError(path)
                        upright = page.filter(lambda o: o.get("object_type") != "char" or o.get("upright", True))
                        for w in upright.extract_words(x_tolerance_ratio=0.15, extra_attrs=["fontname", "size"]):
                            name = w["fontname"].lower()
                            out.append((path, len(out), w["text"], w["x0"], w["top"], w["x1"], w["bottom"], n, float(w["size"]), "bold" in name, "italic" in name or "oblique" in name, w["fontname"]))
                if not out:
                    raise ValueError(f"{path}: no text layer")
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SPANS.split(", ")])

    return files.select("path", "content").mapInPandas(run, SPANS)
