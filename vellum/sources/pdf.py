"""Text of PDF files: a cascade of engines, the first that gives enough text wins. Engines that aren't installed are passed over."""

from __future__ import annotations

import importlib.util
import re
import shutil
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, file_hash string, file_size long, engine_used string, text string, char_count long, pages long, warnings array<string>, error string"
LEAST_TEXT = 500


def available_engines() -> list[str]:
    found = [e for e, module in (("pymupdf4llm", "pymupdf4llm"), ("pymupdf", "fitz"), ("pdfplumber", "pdfplumber"), ("pypdf", "pypdf"), ("markitdown", "markitdown")) if importlib.util.find_spec(module)]
    return found + (["pdftotext"] if shutil.which("pdftotext") else []) + ["streams"]


def text_by_streams(raw: bytes) -> tuple[str, int]:
    """Text shown by the content streams of simple PDF files, without any library."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", raw, re.S):
        data = m.group(1)
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        for t in re.finditer(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:[^\[\]])*)\]\s*TJ", data):
            parts = [t.group(1)] if t.group(1) is not None else re.findall(rb"\(((?:\\.|[^\\()])*)\)", t.group(2))
            out.append(b"".join(re.sub(rb"\\([()\\])", rb"\1", p) for p in parts).decode("latin-1"))
    return "\n".join(out), max(1, len(re.findall(rb"/Type\s*/Page\b", raw)))


def _extract(engine: str, raw: bytes) -> tuple[str, int]:
    import io

    if engine == "pypdf":
        import pypdf

        r = pypdf.PdfReader(io.BytesIO(raw))
        return "\n\n".join(p.extract_text() or "" for p in r.pages), len(r.pages)
    if engine == "pymupdf":
        import fitz

        d = fitz.open(stream=raw, filetype="pdf")
        return "\n\n".join(p.get_text() for p in d), d.page_count
    if engine == "pdfplumber":
        import pdfplumber

        with pdfplumber.open(io.BytesIO(raw)) as d:
            return "\n\n".join(p.extract_text() or "" for p in d.pages), len(d.pages)
    if engine == "streams":
        return text_by_streams(raw)
    raise RuntimeError(f"{engine} needs a file of its own")


def ingest(spark: SparkSession, path: str, engines: list[str] | None = None, least: int = LEAST_TEXT) -> DataFrame:
    """One row per *.pdf below a folder. A file that no engine reads comes out with its error; none fails the job."""
    engines = engines or [e for e in available_engines() if e in ("pymupdf", "pdfplumber", "pypdf", "streams")]

    def run(frames: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        for frame in frames:
            rows = []
            for p, raw in zip(frame["path"], frame["content"], strict=True):
                raw, best, warnings, error = bytes(raw), ("", 0, None), [], None
                for e in engines:
                    try:
                        t, n = _extract(e, raw)
                    except Exception as x:  # noqa: BLE001
                        warnings.append(f"{e}: {type(x).__name__}")
                        continue
                    if len(t) > len(best[0]):
                        best = (t, n, e)
                    if len(t) > least:
                        break
                if best[2] is None:
                    error = "no engine could read it"
                rows.append((p.rsplit("/", 1)[-1], hashlib.sha256(raw).hexdigest(), len(raw), best[2], best[0] or None, len(best[0]), best[1], warnings, error))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,PDF}").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)
