"""Conditions on remote articles: fewer ids are fetched, the rows are the same."""

import http.server
import threading
from urllib.parse import parse_qs, urlparse

import pytest

from quire.sources import remote

DATES = {str(i): d for i, d in enumerate(["2015-Mar", "2016", "2017-Jun-05", "2018", "2019-Jan", "2020-Dec-31", "Unknown", "2021", "2022-Feb", "2023"])}


@pytest.fixture(scope="module")
def service():
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            path, q = urlparse(self.path).path, parse_qs(urlparse(self.path).query)
            if path.endswith("esearch.fcgi"):
                low, high = (int(q[k][0][:4]) if k in q else None for k in ("mindate", "maxdate"))
                ids = [i for i, d in DATES.items() if low is None or d[:4].isdigit() and low <= int(d[:4]) <= high]
                given = ids[: int(q["retmax"][0])]
                body = f"<r><Count>{len(ids)}</Count><IdList>" + "".join(f"<Id>{i}</Id>" for i in given) + "</IdList></r>"
            else:
                asked.extend(q["id"][0].split(","))
                date = lambda d: "" if d == "Unknown" else "".join(f"<{k}>{v}</{k}>" for k, v in zip(("Year", "Month", "Day"), d.split("-")))
                body = "<Set>" + "".join(f"<PubmedArticle><PMID>{i}</PMID><ArticleTitle>T</ArticleTitle><PubDate>{date(DATES[i])}</PubDate></PubmedArticle>" for i in q["id"][0].split(",")) + "</Set>"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


CONDITIONS = {
    "pmid = '3'": {"3"},
    "pmid in ('3', '9', 'none')": {"3", "9"},
    "pub_date = '2018'": {"2", "3", "4"},
    "pub_date <= '2016'": {"0", "1", "2"},
    "pub_date < '2016' and pub_date is not null": {"0", "1", "2"},
    "pub_date between '2018' and '2019-12'": {"2", "3", "4", "5"},
    "pub_date like '2020%'": {"4", "5", "7"},
    "pub_date >= '2021'": set(DATES),
    "pub_date >= '2021' and pmid = '6'": {"6"},
    "pub_date <= 'Z'": set(DATES),
    "title = 'T' or pub_date < '2016'": set(DATES),
}


@pytest.mark.parametrize("condition", CONDITIONS)
def test_fewer_ids_and_equal_rows(spark, service, condition):
    url, asked = service
    remote.register(spark)
    load = lambda: spark.read.format("articles").option("url", url).option("term", "x").option("batch_size", "3").option("pause_s", "0").load()
    everything = [(r["pmid"], r["pub_date"]) for r in load().collect()]
    assert len(everything) == 10
    asked.clear()
    got = sorted((r["pmid"], r["pub_date"]) for r in load().filter(condition).collect())
    assert set(asked) == CONDITIONS[condition]
    held = spark.createDataFrame([(*r, "T") for r in everything], "pmid string, pub_date string, title string")
    assert got == sorted((r["pmid"], r["pub_date"]) for r in held.filter(condition).collect())


def test_a_cut_search_narrows_nothing(spark, service):
    """The years' search has more results than it may give, so the ids found without it stay."""
    url, asked = service
    remote.register(spark)
    df = spark.read.format("articles").option("url", url).option("term", "x").option("max_results", "2").option("pause_s", "0").load()
    asked.clear()
    assert [r["pmid"] for r in df.filter("pub_date < '2020'").collect()] == ["0", "1"] and set(asked) == {"0", "1"}
