"""The registry of extractors by file extension, and extraction as a distributed operator."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import normalize
from docspark.sources.extracted import Extracted, ExtractError
from docspark.sources.markdown import extract_markdown
from docspark.sources.office import extract_docx, extract_pptx, extract_xlsx
from docspark.sources.pdf import extract_pdf
from docspark.sources.tables import extract_csv

#: Fixed value: the largest file that is read.
MOST_BYTES = 512 << 20
Extractor = Callable[[bytes, str], Extracted]
#: Extensions to extractors; ``register`` replaces or adds some, such as one that also reads scanned pages.
REGISTRY: dict[str, Extractor] = {
    **dict.fromkeys(("txt", "text"), lambda raw, _: Extracted(normalize(raw))),
    **dict.fromkeys(("md", "markdown", "mdown", "mkd"), lambda raw, _: extract_markdown(raw)),
    **dict.fromkeys(("csv", "tsv"), extract_csv),
    "pdf": lambda raw, _: extract_pdf(raw),
    "docx": lambda raw, _: extract_docx(raw),
    "pptx": lambda raw, _: extract_pptx(raw),
    "xlsx": lambda raw, _: extract_xlsx(raw),
}
SCHEMA = "status string, message string, text string, pages array<long>, title string"


def register(extension: str, extractor: Extractor) -> None:
    REGISTRY[extension.lower()] = extractor


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*REGISTRY)


def extract(raw: bytes, path: str, registry: dict[str, Extractor] | None = None) -> Extracted:
    m = re.search(r"\.([^./]+)$", path)
    ext = m[1].lower() if m else ""
    registry = REGISTRY if registry is None else registry
    if ext not in registry:
        raise ExtractError("UNSUPPORTED", f"no extractor for .{ext}")
    if len(raw) > MOST_BYTES:
        raise ExtractError("TOO_LARGE", "the file is too large")
    return registry[ext](raw, ext)


def safe_extract(raw: bytes | None, path: str, registry: dict[str, Extractor] | None = None) -> dict:
    """A row of SCHEMA; whatever goes wrong in one file becomes its status and never stops a job."""
    try:
        if raw is None:
            raise ExtractError("UNREADABLE", "cannot read file")
        x = extract(bytes(raw), path, registry)
        return {"status": "ok", "message": "", "text": x.text, "pages": x.pages, "title": x.title}
    except ExtractError as e:
        return {"status": e.status, "message": str(e), "text": "", "pages": [], "title": ""}
    except Exception as e:
        return {"status": "CORRUPT", "message": f"{type(e).__name__}: {e}"[:300], "text": "", "pages": [], "title": ""}


def extract_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Rows (path, content) to the file's columns but its content, with status, message, text, pages and title."""
    registry = dict(REGISTRY)  # with what was registered on the driver
    rest = [c for c in files.columns if c != content_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [safe_extract(raw, p, registry) for raw, p in zip(b[content_col], b[path_col], strict=True)]
            yield pd.concat([b[rest].reset_index(drop=True), pd.DataFrame(rows, columns=["status", "message", "text", "pages", "title"])], axis=1)

    kinds = ", ".join(f"`{c}` {t}" for c, t in files.dtypes if c != content_col)
    return files.mapInPandas(run, f"{kinds}, {SCHEMA}")
