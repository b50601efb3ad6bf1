"""The pipeline against a plain version of its stages, and what is left when the subpackage goes."""

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from test_dedup import kept_lines, passages_left
from test_exact import least_of_components
from test_tokens import packed
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import quality
from quire.llm.library_tokens import vocabulary

ROOT = Path(__file__).resolve().parents[2]


def test_against_plain_version(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(table, spark.read.parquet(f"{sf}/labels.parquet"), ~quality.held_out(F.col("doc_id")))
    docs = sorted((r["doc_id"], r["text"]) for r in table.collect())
    scores = model.score(np.array([quality.features(t) for _, t in docs]))
    want = [d for d, s in zip(docs, scores, strict=True) if s >= quality.THRESHOLD]
    plain = [want]
    want = kept_lines(want)
    plain.append(want)
    want = [d for d, (_, least) in zip(want, least_of_components(want), strict=True) if d[0] == least]
    plain.append(want)
    want = passages_left(want)
    plain.append(want)

    now = table
    for (name, stage), expected in zip(corpus_pipeline.STAGES, plain, strict=False):
        now = corpus_pipeline.written(stage(spark, now, sf), name)
        assert now.columns == table.columns, name
        assert now.dtypes == table.dtypes, name
        assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == expected, name
        assert now.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    assert 0 < len(want) < len(docs)

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    by_doc, sequences = packed(corpus_pipeline.run(spark, sf).collect())
    lengths = {i: 1 + len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in want}
    assert {i: sum(r["length"] for r in rows) for i, rows in by_doc.items()} == lengths
    assert sequences <= 1.02 * -(-sum(lengths.values()) // 1024) + 1


def test_odd_rows(spark, sf):
    """Nulls, empty and repeated rows pass every stage; an empty table gives no rows."""
    text = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id = 1").first()["text"]
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + " Its own end.", None, None, None), (5, "word " * 40_000, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = corpus_pipeline.written(stage(spark, now, sf), f"odd-{name}")
            if name == "near_copies" and given is docs:
                ids = [r["doc_id"] for r in now.collect()]
                assert set(ids) >= {1, None} and ids.count(1) == 1
        assert (now.count() > 0) == (given is docs)


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage, its tests and the pipeline the other tests pass; this runs a part of them that needs little time."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    assert not (copy / "quire" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'similar_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "tests/", "-q", "-k", "registry or topics or xml or entry or similar"], cwd=copy, check=True, timeout=900)
