"""PDF files as lines, through a library that may be missing: without it, lines come as Parquet of the same schema."""

from __future__ import annotations

from collections.abc import Iterator
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.functions.text import is_math_only

SCHEMA = "path string, line_seq int, page int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string, font_size double, spans array<struct<font:string,text:string>>"


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [OneFile(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pymupdf

        seq = 0
        with pymupdf.open(partition.path) as doc:
            for number, page in enumerate(doc):
                size = (float(page.rect.width), float(page.rect.height))
                for block in page.get_text("dict")["blocks"]:
                    for line in block.get("lines", []):
                        spans = [(s["font"], s["text"]) for s in line["spans"]]
                        text = " ".join("".join(s for _, s in spans).split())
                        if text:
                            yield (partition.path, seq, number, *size, *map(float, line["bbox"]), text, float(max(s["size"] for s in line["spans"])), spans)
                            seq += 1


class PdfLines(DataSource):
    """spark.read.format("pdf_lines").load("a.pdf,b.pdf"), a task a file."""

    @classmethod
    def name(cls) -> str:
        return "pdf_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options)


def document_id(path: Column) -> Column:
    return F.xxhash64(path)


def as_lines(raw: DataFrame) -> DataFrame:
    """Lines as the source has them, to the relation that noise, regions and reflow take."""
    return raw.select(document_id(F.col("path")).alias("doc_id"), "line_seq", "page", "x0", "y0", "x1", "y1", "text", "font_size", is_math_only(F.col("spans")).alias("math_only"))


def as_pages(raw: DataFrame) -> DataFrame:
    """(doc_id, page, width, height) of the pages that hold a line."""
    return raw.select(document_id(F.col("path")).alias("doc_id"), "page", "width", "height").distinct()


def stems(raw: DataFrame) -> DataFrame:
    """(doc_id, stem): the name of a document without headings."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return raw.select("path").distinct().select(document_id(F.col("path")).alias("doc_id"), name.alias("stem"))


def available() -> bool:
    return find_spec("pymupdf") is not None


def read_pdfs(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not available():
        raise RuntimeError("reading PDF files needs pymupdf; give lines as Parquet instead")
    spark.dataSource.register(PdfLines)
    return spark.read.format("pdf_lines").load(",".join(paths))
