"""Files that are no well-formed XML, stages that a failed write left, rows without an id."""

import pytest
from pyspark.sql import functions as F

from quire.sources import articles, tables

ONE = "<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>T{0}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
A, B = ONE.format(1), ONE.format(2)


def ids(spark, tmp_path, text):
    (tmp_path / "x.xml").write_text(text)
    return sorted(r["pmid"] for r in articles.read_articles(spark, str(tmp_path / "x.xml")).collect())


@pytest.mark.parametrize("text", [f"<Set>{A}<oops>{B}</Set>", f"<Set>{A}{B[: -len('</PubmedArticle>')]}", f"<Set>{A}{B}", f"{A}{B}</Set>", f"<Set>{A}stray{B}</Set>", f"<Set>{A}</Set><Set>", f"<Set><Part>{A}</Set>"])
def test_broken_wrappers_raise(spark, tmp_path, text):
    with pytest.raises(articles.NotWellFormed):
        ids(spark, tmp_path, text)


@pytest.mark.parametrize("text", [f"<?xml version='1.0'?>\n<!DOCTYPE Set [<!ELEMENT a (b)>]>\n<Set x='1'>\n{A}<!-- <oops> -->\n{B}\n<Empty/></Set>\n", f"<Set><Part>{A}</Part><Part>{B}</Part></Set>", f"{A}\n{B}", f"<Set>{A}<![CDATA[ <oops> ]]>{B}</Set>"])
def test_whole_files_are_read(spark, tmp_path, text):
    assert ids(spark, tmp_path, text) == ["1", "2"]


def test_check_can_be_left_out(spark, tmp_path):
    (tmp_path / "x.xml").write_text(f"<Set>{A}<oops>{B}</Set>")
    assert articles.read_articles(spark, str(tmp_path / "x.xml"), check=False).count() == 2


def test_a_failed_stage_is_built_again(spark, tmp_path):
    path = tmp_path / "stage"
    path.mkdir()
    (path / "part-0.parquet").write_text("cut off")
    built = tables.materialise(spark, str(path), lambda: spark.range(3))
    assert built.count() == 3 and tables.ready(spark, str(path))
    assert tables.materialise(spark, str(path), lambda: spark.range(9)).count() == 3
    tables.finish(spark, str(tmp_path / "model"))
    assert tables.ready(spark, str(tmp_path / "model")) and not tables.ready(spark, str(tmp_path / "none"))


def test_rows_without_an_id_stay(spark):
    rows = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a"), (None, 1, "x"), (None, 1, "x"), (None, 2, "y")], "pmid string, place int, text string")
    got = sorted((r["pmid"] or "", r["text"]) for r in tables.dedup_papers(rows, "place").collect())
    assert got == [("", "x"), ("", "x"), ("", "y"), ("1", "a")]
    nameless = spark.range(100_000).select(F.lit(None).cast("string").alias("pmid"), F.lit(0).alias("place"), F.lit("t").alias("text"))
    plan = tables.dedup_papers(nameless, "place")
    assert plan.count() == 100_000
