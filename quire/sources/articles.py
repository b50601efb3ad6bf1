"""Article XML to paper rows, by one parser for files, lines and the remote service."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.schemas import RAW_PAPER
from quire.shipping import ship

ROW_TAG = "PubmedArticle"
_START = re.compile(rf"<{ROW_TAG}[\s>]")


class NotWellFormed(ValueError):
    """A file whose elements around its articles don't close, or whose last article is cut off."""


def read_articles(spark: SparkSession, path: str, compat: bool = False, check: bool = True) -> DataFrame:
    """Files of articles at any depth, split after each article, so that many tasks read one file.  XML that is not well-formed raises: tolerance would lose what follows it.

    An article is checked as it is parsed; what stands around the articles in a pass of its own over the files, before, unless ``check`` is unset."""
    ship(spark)
    records = spark.read.option("lineSep", f"</{ROW_TAG}>").text(path)
    if check:
        check_wrappers(records)
    return _papers(records, True, compat)


def check_wrappers(records: DataFrame) -> None:
    """Raises where a file's elements outside of articles are not closed as often as opened, or stray text or an unclosed article stands there."""
    around = F.regexp_extract("value", rf"(?s)^(.*?)(?:<{ROW_TAG}[\s>].*)?$", 1)
    left = records.select(F.col("_metadata.file_path").alias("file"), around.alias("text")).filter(F.trim(F.regexp_replace("text", r"\s+", "")) != "")
    bare = F.regexp_replace("text", r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>\[]*(?:\[.*?\]\s*)?>", "")
    tag = F.explode(F.regexp_extract_all(bare, F.lit(r"</?[A-Za-z_:][^<>]*>"), F.lit(0)))
    tags = left.select("file", tag.alias("tag")).select(
        "file",
        F.regexp_extract("tag", r"^</?([^\s/>]+)", 1).alias("name"),
        F.when(F.col("tag").startswith("</"), -1).when(F.col("tag").endswith("/>"), 0).otherwise(1).alias("step"),
    )
    open_ = tags.groupBy("file", "name").agg(F.sum("step").alias("open")).filter("open <> 0")
    stray = left.filter(F.regexp_replace(bare, r"</?[A-Za-z_:][^<>]*>|\s+", "") != "").select("file", F.lit("text").alias("name"), F.lit(1).cast("long").alias("open"))
    found = open_.unionByName(stray).orderBy("file", "name").limit(5).collect()
    if found:
        raise NotWellFormed("; ".join(f"{r['file']}: {r['name']} ({r['open']:+d})" for r in found))


def read_article_lines(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """One article a line; a line that is no XML is skipped, and no other."""
    ship(spark)
    return _papers(spark.read.text(path), False, compat)


def _papers(records: DataFrame, split: bool, compat: bool) -> DataFrame:
    schema = to_arrow_schema(RAW_PAPER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                rows = []
                for text in batch.column(0).slice(i, 1_000).to_pylist():
                    start = _START.search(text)
                    if not start:
                        continue
                    try:
                        row = paper_of(ET.fromstring(f"{text[start.start():]}</{ROW_TAG}>" if split else text[start.start() :]), compat)
                    except ET.ParseError:
                        if split:
                            raise
                        continue
                    if row:
                        rows.append(row)
                columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return records.mapInArrow(run, RAW_PAPER)


def paper_of(article: ET.Element, compat: bool = False) -> tuple | None:
    """One element as a RAW_PAPER row; None without an id, or with neither title nor abstract.  An element's text is all of it without inline tags, or with compat what stands before the first."""

    def text(element: ET.Element | None) -> str:
        return "" if element is None else (element.text or "") if compat else "".join(element.itertext())

    pmid = article.findtext(".//PMID")
    title = text(article.find(".//ArticleTitle"))
    parts = [(p.get("Label"), text(p)) for p in article.iter("AbstractText")]
    abstract = " ".join(f"{label}: {said}" if label else said for label, said in parts if said)
    if not pmid or not (title or abstract):
        return None
    authors = [f"{a.findtext('ForeName')} {a.findtext('LastName')}" for a in article.iter("Author") if a.findtext("ForeName") and a.findtext("LastName")]
    terms = [said for d in article.iterfind(".//MeshHeading/DescriptorName") if (said := text(d))]
    return pmid, title, abstract, authors, text(article.find(".//Journal/Title")), pub_date(article.find(".//PubDate")), terms, f"{title}. {abstract}".strip()


def pub_date(date: ET.Element | None) -> str:
    """Year[-Month[-Day]], else the first ten characters of a range, else 'Unknown'."""
    year, month, day, span = (date.findtext(k) if date is not None else None for k in ("Year", "Month", "Day", "MedlineDate"))
    return "-".join(x for x in (year, month, day if month else None) if x) if year else span[:10] if span else "Unknown"
