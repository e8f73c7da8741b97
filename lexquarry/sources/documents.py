"""Uploaded files and their pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexquarry.config import EngineConfig

PageReader = Callable[[bytes], list[str]]
PageOcr = Callable[[bytes, int], str | None]


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, content, size): files of a folder, read where the tasks run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.col("length").alias("size"))


#: An encrypted PDF names its encryption dictionary in the trailer.
ENCRYPTED = r"/Encrypt\s+\d+\s+\d+\s+R"


def file_problem(content: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Why a file is not taken in: EMPTY, TOO_LARGE, NOT_PDF, ENCRYPTED; null when it is."""
    size = F.octet_length(content)
    return (
        F.when(content.isNull() | (size == 0), "EMPTY").when(size > config.upload_max_bytes, "TOO_LARGE")
        .when(F.call_function("substring", content, F.lit(1), F.lit(5)) != F.lit(bytearray(b"%PDF-")), "NOT_PDF")
        .when(F.decode(content, "ISO-8859-1").rlike(ENCRYPTED), "ENCRYPTED")
    )


def form_feed_pages(content: bytes) -> list[str]:
    """Default reader: text with form feeds between the pages.  A PDF reader plugs in here."""
    return content.decode("utf-8", errors="replace").split("\f")


def extract_pages(files: DataFrame, reader: PageReader = form_feed_pages, ocr: PageOcr | None = None,
                  config: EngineConfig = EngineConfig(), pages: tuple[int, int] | None = None) -> DataFrame:
    """(path, page_number, text, is_ocr, problem): one row per page, or one row of page 0 with a problem.

    Files are checked before the reader sees them; one with a problem is not shipped to it.  Pages with little text go to ``ocr``, the
    first ``ocr_max_pages`` of a file only.  ``pages`` names the first and the last page wanted, counted from 1.  Problems of the
    reader: UNREADABLE, NO_PAGES, and NO_TEXT for a file of which no page wanted holds any.
    """
    first, last = pages or (1, None)
    if first < 1 or (last is not None and last < first):
        raise ValueError(f"bad page range {first}..{last}")

    def one(path: str, content: bytes) -> Iterator[tuple]:
        try:
            texts = reader(content)
        except Exception as e:  # noqa: BLE001 - a broken file must not end the job
            yield path, 0, "", False, f"UNREADABLE {e}"
            return
        wanted = list(enumerate(texts, 1))[first - 1:last]
        if not wanted:
            yield path, 0, "", False, "NO_PAGES"
            return
        found = []
        for number, text in wanted:
            text, used = text.strip(), False
            if ocr and len(text) < config.ocr_min_chars and number <= config.ocr_max_pages:
                seen = ocr(content, number)
                text, used = (seen, True) if seen else (text, False)
            found.append((path, number, text, used, None))
        yield from found if any(row[2] for row in found) else [(path, 0, "", False, "NO_TEXT")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                yield pd.DataFrame(list(one(path, bytes(content))), columns=["path", "page_number", "text", "is_ocr", "problem"])

    schema = "path string, page_number int, text string, is_ocr boolean, problem string"
    problem = file_problem(F.col("content"), config)
    refused = files.where(problem.isNotNull()).select(
        F.col("path").cast("string").alias("path"), F.lit(0).alias("page_number"), F.lit("").alias("text"), F.lit(False).alias("is_ocr"),
        problem.alias("problem"))
    return files.where(problem.isNull()).select(F.col("path").cast("string").alias("path"), "content").mapInPandas(read, schema).unionByName(refused)


ElementReader = Callable[[bytes], list[tuple[int, float, float, float, str]]]


def extract_elements(files: DataFrame, reader: ElementReader) -> DataFrame:
    """(path, page, element, x, y, font_size, text): positioned text, from a reader that plugs in.

    The reader lists (page, x, y, font size, text); blank text is left out.
    """
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                found = [(path, p, i, float(x), float(y), float(s), t.strip())
                         for i, (p, x, y, s, t) in enumerate(reader(bytes(content))) if t.strip()]
                yield pd.DataFrame(found, columns=["path", "page", "element", "x", "y", "font_size", "text"])

    return files.select("path", "content").mapInPandas(
        read, "path string, page int, element int, x double, y double, font_size double, text string")


def page_lines(pages: DataFrame, group: list[str], text: str = "text", page: str = "page_number") -> DataFrame:
    """Lines of pages, numbered from 1 within a page."""
    return pages.select(*group, F.col(page).alias("page"), F.posexplode(F.split(text, "\n", -1)).alias("_i", "text")).select(
        *group, "page", (F.col("_i") + 1).alias("line_no"), "text")
