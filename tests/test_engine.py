"""Sources, trends, topics, search, the facade and streaming on small inline tables."""

import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quire import edge
from quire.config import EngineConfig
from quire.engine import Engine, NotFound, NotReady
from quire.functions import dates
from quire.operators import charts, search, topics, trends
from quire.schemas import RAW_PAPER
from quire.sources import articles, remote, tables
from quire.streaming import ingest


def article(pmid, title="A title", parts=(("", "Body text."),), date="<Year>2020</Year>", people=(("Ada", "Lovelace"),), terms=("T1",)):
    abstract = "".join(f'<AbstractText Label="{k}">{v}</AbstractText>' if k else f"<AbstractText>{v}</AbstractText>" for k, v in parts)
    names = "".join(f"<Author><LastName>{b}</LastName><ForeName>{a}</ForeName></Author>" if a else f"<Author><LastName>{b}</LastName></Author>" for a, b in people)
    heads = "".join(f'<MeshHeading><DescriptorName UI="D1">{t}</DescriptorName></MeshHeading>' for t in terms)
    own = f'<PMID Version="1">{pmid}</PMID>' if pmid else ""
    return (
        f"<PubmedArticle><MedlineCitation>{own}<Article><Journal><JournalIssue><PubDate>{date}</PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>{title}</ArticleTitle>"
        f"<Abstract>{abstract}</Abstract><AuthorList>{names}</AuthorList></Article><MeshHeadingList>{heads}</MeshHeadingList></MedlineCitation></PubmedArticle>"
    )


ARTICLES = [
    article("001", title="A <i>b</i> c", parts=(("AIM", "One."), ("", "Two.")), date="<Year>2020</Year><Month>Jun</Month><Day>05</Day>", people=(("Ada", "Lovelace"), ("", "Group"))),
    article(None),
    article("3", title="", parts=(), terms=()),
    article("4", date="<MedlineDate>2019 Jan-Feb</MedlineDate>", terms=("T1", "T2")),
    article("5", date="<Year>2018</Year><Day>7</Day>"),
    article("6", date=""),
]
WANT = {
    "001": ("A b c", "AIM: One. Two.", ["Ada Lovelace"], "2020-Jun-05"),
    "4": ("A title", "Body text.", ["Ada Lovelace"], "2019 Jan-F"),
    "5": ("A title", "Body text.", ["Ada Lovelace"], "2018"),
    "6": ("A title", "Body text.", ["Ada Lovelace"], "Unknown"),
}


def seen(df):
    return {r["pmid"]: (r["title"], r["abstract"], r["authors"], r["pub_date"]) for r in df.collect()}


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><Set>" + "".join(ARTICLES) + "</Set>")
    assert seen(articles.read_articles(spark, str(tmp_path / "a.xml"))) == WANT
    assert seen(articles.read_articles(spark, str(tmp_path / "a.xml"), compat=True))["001"][0] == "A "
    (tmp_path / "bad.xml").write_text("<Set>" + ARTICLES[0] + "<PubmedArticle><MedlineCitation></PubmedArticle>" + ARTICLES[3] + "</Set>")
    with pytest.raises(Exception):
        articles.read_articles(spark, str(tmp_path / "bad.xml")).collect()
    marked = [
        article("7", title="A &lt; B <i>b</i> &amp; c", parts=(("", "Level of <i>p53</i> rose in all cells."), ("END", "x<sub>2</sub> &gt; 1"))).replace("<Title>J</Title>", "<Title>J &amp; <i>K</i></Title>"),
        article("8", title="<b>All</b> marked", parts=(("", "<i>p53</i> rose."),)),
    ]
    (tmp_path / "marked.xml").write_text("<Set>\n" + "\n".join(marked) + "\n</Set>\n")
    (tmp_path / "marked.txt").write_text("\n".join(marked))
    for read, name in ((articles.read_articles, "marked.xml"), (articles.read_article_lines, "marked.txt")):
        rows = {r["pmid"]: r for r in read(spark, str(tmp_path / name)).collect()}
        assert seen(read(spark, str(tmp_path / name)).filter("pmid = 7"))["7"][:2] == ("A < B b & c", "Level of p53 rose in all cells. END: x2 > 1")
        assert rows["7"]["journal"] == "J & K" and rows["8"]["title"] == "All marked" and rows["8"]["abstract"] == "p53 rose."
        first = read(spark, str(tmp_path / name), compat=True).filter("pmid = 7").first()
        assert (first["title"], first["abstract"], first["journal"]) == ("A < B ", "Level of  END: x", "J & ")
    (tmp_path / "lines.txt").write_text("\n".join([ARTICLES[0], "<PubmedArticle><broken>", ARTICLES[3]]))
    assert set(seen(articles.read_article_lines(spark, str(tmp_path / "lines.txt")))) == {"001", "4"}


def test_remote(spark):
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path, q = urlparse(self.path).path, parse_qs(urlparse(self.path).query)
            asked.append((path, q))
            if path.endswith("esearch.fcgi"):
                body = "<r><IdList>" + "".join(f"<Id>{i}</Id>" for i in range(5)) + "</IdList></r>"
            else:
                body = "<Set>" + "".join(article(i) for i in q["id"][0].split(",")) + ARTICLES[1] + "</Set>"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    remote.register(spark)
    df = spark.read.format("articles").option("url", f"http://127.0.0.1:{server.server_port}").option("term", "x").option("batch_size", "2").option("max_results", "5").option("date_from", "2018/01/01").option("date_to", "2020/01/01").option("pause_s", "0").load()
    assert sorted(r["pmid"] for r in df.collect()) == list("01234")
    first = list(asked)
    assert df.filter("pub_date >= '2018'").count() == 5
    server.shutdown()
    assert {q["mindate"][0] for p, q in asked if "esearch" in p} == {"2018/01/01"}
    assert sorted(q["id"][0] for p, q in first if "efetch" in p) == ["0,1", "2,3", "4"]
    assert any(q.get("mindate") == ["2018/01/01"] for p, q in asked if "esearch" in p)


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "p")
    papers = spark.createDataFrame([("1", "é", None, ["a"], "J", "2020", [], "x")], RAW_PAPER)
    tables.write_jsonl(papers, path)
    assert tables.read_jsonl(spark, path, RAW_PAPER).select("pmid", "title", "authors").collect() == papers.select("pmid", "title", "authors").collect()
    assert tables.read_jsonl(spark, str(tmp_path / "none"), RAW_PAPER).count() == 0
    (tmp_path / "bad.json").write_text('{"pmid": "1"}\n\n{bad\n')
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(tmp_path / "bad.json"), RAW_PAPER).collect()


def test_union(spark):
    a, b = (spark.createDataFrame([(i, s) for i in ids], "pmid string, s string") for ids, s in ((["1", "2"], "a"), (["2", "3"], "b")))
    assert tables.union_domains([a, b]).count() == 4
    assert sorted(map(tuple, tables.union_domains([a, b], dedup=True).collect())) == [("1", "a"), ("2", "a"), ("3", "b")]


DATES = [
    ("2020", "2020", "2020", None, None, "2020-01-01"),
    ("2020-Jun-05", "2020", "2020", "2020-Ju", "2020-06", "2020-06-05"),
    ("2020-Jul", "2020", "2020", "2020-Ju", "2020-07", "2020-07-01"),
    ("2020-03-01", "2020", "2020", "2020-03", "2020-03", "2020-03-01"),
    ("2019 Jan-F", "2019 Jan", "2019", "2019 Ja", None, "2019-01-01"),
    ("Unknown", None, None, None, None, None),
    ("", "", None, None, None, None),
    (None, None, None, None, None, None),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DATES)], "i int, d string")
    c = F.col("d")
    got = df.select("i", dates.year_token(c), dates.year(c), dates.month_key_compat(c), dates.month_key(c), dates.as_date(c).cast("string"), dates.int_year(c)).orderBy("i").collect()
    assert [tuple(r)[1:6] for r in got] == [d[1:] for d in DATES]
    assert [r[6] for r in got] == [2020, 2020, 2020, 2020, None, None, None, None]


def test_growth(spark):
    series = {1: [2, 5], 2: [4, 1], 3: [1, 2, 6], 4: [9], -1: [1, 5]}
    rows = [(t, f"2020-{m + 1:02d}-15") for t, s in series.items() for m, n in enumerate(s) for _ in range(n)]
    df = spark.createDataFrame(rows, "topic_id int, date string").withColumn("date", F.col("date").cast("date"))
    got = {r["topic_id"]: (r["growth_rate"], r["avg_count"], round(r["growth_score"], 6)) for r in topics.topic_trends(df).collect()}
    assert got == {1: (1.5, 3.5, 2.256116), 2: (-0.75, 2.5, -0.939572), 3: (2.0, 3.0, 2.772589)}
    assert [r["topic_id"] for r in topics.trending(topics.topic_trends(df), 2).collect()] == [3, 1]
    assert topics.topic_trends(df.limit(0)).count() == 0


def test_term_growth(spark):
    counts = {"a": {2018: 1, 2019: 3, 2020: 5}, "b": {2019: 2, 2020: 2}, "c": {2020: 9}}
    rows = [(f"{t}{y}{i}", str(y), [t]) for t, ys in counts.items() for y, n in ys.items() for i in range(n)]
    papers = spark.createDataFrame(rows, "pmid string, pub_date string, mesh_terms array<string>")
    assert [tuple(r) for r in trends.growing_terms(papers).collect()] == [("a", 1.5, 5, 9)]


def test_collaboration(spark):
    papers = spark.createDataFrame([("1", []), ("2", ["a"]), ("3", ["a", "b"]), ("4", list("abcde")), ("5", list("abcdef")), ("6", ["a", "a"])], "pmid string, authors array<string>")
    assert tuple(trends.collaboration(papers).first()) == (16 / 5, 6, 1, 3, 1, 6)
    assert trends.author_counts(papers, 1).first()["paper_count"] == 6
    assert trends.collaboration(papers.filter("pmid = 1")).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [1.0, 0.0]), ("3", [0.0, 1.0]), ("4", [-1.0, 0.0]), ("5", [0.0, 0.0])], "pmid string, embedding array<float>")
    assert [r["pmid"] for r in search.similar(v, "1", 10).collect()] == ["2", "3", "5", "4"]
    assert search.similar(v, "1", 0).count() == 4
    assert search.similar(v, "none").count() == 0
    assert [r["pmid"] for r in search.top_k(v, [1.0, 0.0], 2).collect()] == ["1", "2"]


def test_cards(spark):
    papers = spark.createDataFrame([("1", "t", "J" * 40, "a" * 501, list("abcdef"))], "pmid string, title string, journal string, abstract string, mesh_terms array<string>")
    assert tuple(charts.cards(papers).first()) == ("1", "t", "J" * 30 + "...", "a" * 500 + "...", "a, b, c, d, e...")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    words = {"cell": "Gene editing of living cells repairs damaged genes in tissue", "star": "Distant galaxies and bright stars emit light across space"}
    rows = [(f"{k}{i}", f"{k} study {i}", f"{text} number {i}. " * 3, [f"A{i % 3}", "B"], f"Journal {i % 2}", f"20{18 + i % 3}-0{1 + i % 6}-01", [k, "common"], "") for k, text in words.items() for i in range(12)]
    e = Engine(spark, str(tmp_path_factory.mktemp("home")), EngineConfig(num_topics=2, min_topic_size=2, embedding_dim=64))
    with pytest.raises(NotReady):
        e.papers()
    e.ingest(spark.createDataFrame([*rows, ("short", "", "too short", [], "", "", [], "")], RAW_PAPER))
    assert all(r["ready"] for r in e.run_pipeline().collect())
    return e


def test_facade(engine):
    assert engine.papers().count() == 24
    assert tuple(engine.processing().first()) == (25, 24, 1)
    words = [r["word"] for r in engine.keywords().collect()]
    assert len(words) == 20 and any(" " in w for w in words)
    hits = engine.search("gene cells tissue", 5).collect()
    assert len(hits) == 5 and all(h["pmid"].startswith("cell") for h in hits)
    assert engine.similar("star1", 3).filter(F.col("pmid").startswith("star")).count() == 3
    assert engine.paper("star1").count() == 1
    with pytest.raises(NotFound):
        engine.paper("none")
    assert engine.summarize("stars in space", 3).first()["num_papers"] == 3
    assert engine.paper_summary("cell1").first()["summary"]
    info = {r["topic_id"]: r["count"] for r in engine.topic_info().collect()}
    assert sum(info.values()) == 24 and set(info) == {0, 1}
    detail = engine.topic(0).first()
    assert detail["num_papers"] == info[0] and detail["top_papers"] and detail["topic_label"]
    with pytest.raises(NotFound):
        engine.topic(99)
    assert engine.trending_topics().count() == 2 and engine.topic_timeline(0).count() > 1
    t = engine.general_trends().first()
    assert t["total_papers"] == 24 and t["time_trends"]["total_years"] == 3 and t["collaboration_trends"]["small_team"] == 24
    assert engine.stats().first()["num_embeddings"] == 24
    assert all(v.count() > 0 for v in engine.visualizations().values())
    assert engine.trending_summaries().count() == 1


def test_json_answers(engine, tmp_path, spark, capsys):
    import quire.__main__ as command

    get = lambda route, **given: (lambda status, body: (status, json.loads(body)))(*edge.answer(engine, route, **given))
    status, found = get("/search", q="gene cells", top_k="3")
    assert status == 200 and found["total_results"] == 3 and found["results"][0]["pmid"].startswith("cell")
    assert get("/paper/star1")[1]["pmid"] == "star1" and get("/paper/star1/summary")[1]["summary"]
    assert get("/similar/star1", top_k=2)[1]["total_results"] == 2
    assert get("/stats")[1]["processing"] == {"seen": 25, "processed": 24, "skipped": 1}
    assert get("/topic/0")[1]["keywords"] and get("/topic/0/timeline")[1]["total_results"] > 0
    assert get("/trends")[1]["total_papers"] == 24 and get("/health")[1]["stages"]["embeddings"]
    assert [get(r)[0] for r in ("/paper/none", "/topic/77", "/nowhere", "/search")] == [404, 404, 404, 400]
    assert edge.answer(Engine(spark, str(tmp_path)), "/stats")[0] == 503
    assert command.main(["get", engine.home, "/summarize", "q=stars"]) == 0 and "num_papers" in capsys.readouterr().out
    assert command.main(["demo-topics", engine.home]) == 0 and command.main(["nothing", engine.home]) == 2


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"pmid": str(i % 3), "title": "t", "abstract": "word " * 20, "arrived": "2024-01-01T00:00:00Z"} for i in range(6)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = ingest.processed_stream(ingest.paper_stream(spark, str(tmp_path / "in")))
    ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["pmid"] for r in got.collect()) == ["0", "1", "2"] and got.first()["word_count"] == 21


def test_partitions_do_not_matter(spark, sf):
    from quire.plans import views

    papers = views.papers_meta(spark, sf)
    one, many = (sorted(map(repr, trends.growing_terms(papers.repartition(n)).collect())) for n in (1, 16))
    assert one == many


def test_the_rest_needs_no_llm():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "quire"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"quire\.llm|from \.llm", f.read_text()), f
