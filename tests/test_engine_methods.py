"""The facade with the methods that are no defaults: latent vectors, density topics, trained sentences, graph summaries, the index."""

import pytest
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.engine import Engine, NotReady
from quire.schemas import RAW_PAPER


def test_all_methods_together(spark, tmp_path):
    words = {"cell": "Gene editing of living cells repairs damaged genes in tissue", "star": "Distant galaxies and bright stars emit light across space"}
    rows = [(f"{k}{i}", f"{k} study {i}", f"{text} as Dr. Novak said. Number {i} differs in its own way from all others here. " * 2, [f"A{i % 3}", "B"], f"Journal {i % 2}", f"20{18 + i % 3}-0{1 + i % 6}-01", [k, "common"], "") for k, text in words.items() for i in range(12)]
    config = EngineConfig(min_topic_size=4, embedding="latent", latent_dim=8, topic_method="density", topic_components=2, sentence_splitter="trained", summary_method="graph", summary_sentences=2)
    e = Engine(spark, str(tmp_path), config)
    with pytest.raises(NotReady):
        e.index()
    e.ingest(spark.createDataFrame(rows, RAW_PAPER))
    assert all(r["ready"] for r in e.run_pipeline().collect())
    assert e.vectors().select(F.size("embedding")).distinct().collect()[0][0] == 8
    for exact in (True, False):
        hits = e.search("gene cells tissue", 5, exact=exact).collect()
        assert len(hits) == 5 and all(h["pmid"].startswith("cell") for h in hits)
        assert {r["pmid"][:4] for r in e.similar("star3", 4, exact=exact).collect()} == {"star"}
    topics = {r["pmid"]: r["topic_id"] for r in e.assignments().collect()}
    for kind in words:
        own = {t for p, t in topics.items() if p.startswith(kind) and t != -1}
        assert own and not own & {t for p, t in topics.items() if not p.startswith(kind) and t != -1}
    shares = e.topic_distribution("cell1").collect()
    assert abs(sum(r["probability"] for r in shares) - 1) < 1e-9
    assert e.topic_map().count() == len({t for t in topics.values() if t != -1}) and e.topic_hierarchy().count() == e.topic_map().count() - 1
    assert e.paper_summary("cell1").first()["summary"] and "galaxies" in e.paper_summary("star1", "bright stars").first()["summary"]
    assert not any(s.startswith("Novak") for r in e.papers().select("sentences").collect() for s in r["sentences"])
    assert Engine(spark, str(tmp_path), config).embedder().terms == e.embedder().terms
