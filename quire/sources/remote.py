"""A Python data source for a remote article service: one request finds ids, batches of ids are fetched in parallel.

Options: url (of the service), term, date_from, date_to (YYYY/MM/DD), max_results, batch_size, pause_s, email, api_key.
The service has two endpoints below url: esearch.fcgi and efetch.fcgi.  The date range and the limit of the options go to it.

Conditions on the rows make fewer ids be fetched, and Spark applies them again to what comes:

* ids asked for by equality or a list meet the ids found;
* an upper bound of pub_date, with a lower one if there is one, makes a second search of those years and one more at each
  end, whose ids meet the ids found, unless that search has more results than it may give.  A lower bound alone doesn't: the
  column holds text, and 'Unknown' or 'Spring 2019' come after any year.

So the ids fetched are among those found without the conditions, and all that fulfil them are among the ids fetched.
"""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from quire.schemas import RAW_PAPER
from quire.sources.articles import ROW_TAG, paper_of


@dataclass
class Batch(InputPartition):
    ids: tuple[str, ...]


class ArticleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self):
        return RAW_PAPER

    def reader(self, schema):
        return ArticleReader(dict(self.options))


class ArticleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.wanted: set[str] | None = None
        self.first_year: int | None = None
        self.last_year: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("pmid",) and isinstance(f, EqualTo | In):
                ids = {str(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                self.wanted = ids if self.wanted is None else self.wanted & ids
            elif column == ("pub_date",) and isinstance(f, EqualTo | StringStartsWith | LessThan | LessThanOrEqual | GreaterThan | GreaterThanOrEqual) and str(f.value)[:4].isdigit() and len(str(f.value)) >= 4:
                year = int(str(f.value)[:4])
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.last_year = year if self.last_year is None else min(year, self.last_year)
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.first_year = year if self.first_year is None else max(year, self.first_year)
            yield f  # all are applied again

    def _get(self, endpoint: str, **query: str) -> bytes:
        own = {k: self.options[k] for k in ("email", "api_key") if self.options.get(k)}
        with urllib.request.urlopen(f"{self.options['url'].rstrip('/')}/{endpoint}?{urllib.parse.urlencode(query | own)}", timeout=60) as r:
            return r.read()

    def _found(self, query: dict, whole: bool = False) -> list[str] | None:
        """The ids of a search; with ``whole`` None where the service has more than it gave, or doesn't say how many."""
        root = ET.fromstring(self._get("esearch.fcgi", **query))
        ids = [e.text for e in root.iter("Id") if e.text]
        return None if whole and not (root.findtext("Count") or "").isdigit() or whole and int(root.findtext("Count")) > len(ids) else ids

    def partitions(self) -> list[Batch]:
        o = self.options
        query = {"db": "pubmed", "term": o["term"], "retmax": o.get("max_results", "5000"), "retmode": "xml"}
        if o.get("date_from") and o.get("date_to"):
            query |= {"datetype": "pdat", "mindate": o["date_from"], "maxdate": o["date_to"]}
        ids = self._found(query)[: int(o.get("max_results", "5000"))]
        if self.wanted is not None:
            ids = [i for i in ids if i in self.wanted]
        if self.last_year is not None and ids:
            years = (max(1, (self.first_year or 1) - 1), self.last_year + 1)
            near = self._found(query | {"datetype": "pdat", "mindate": f"{years[0]:04}/01/01", "maxdate": f"{years[1]:04}/12/31"}, whole=True)
            held = set(ids if near is None else near)
            ids = [i for i in ids if i in held]
        size = int(o.get("batch_size", "100"))
        return [Batch(tuple(ids[i : i + size])) for i in range(0, len(ids), size)] or [Batch(())]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if not partition.ids:
            return
        root = ET.fromstring(self._get("efetch.fcgi", db="pubmed", id=",".join(partition.ids), retmode="xml"))
        for article in root.iter(ROW_TAG):
            row = paper_of(article)
            if row:
                yield row
        time.sleep(float(self.options.get("pause_s", "0.1")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArticleSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
