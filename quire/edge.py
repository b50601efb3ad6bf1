"""JSON answers by route, for any web server or the command line to send.  Every answer has a bounded number of rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from quire.engine import Engine, NotFound, NotReady


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _one(df: DataFrame) -> dict:
    return (rows(df) or [{}])[0]


def _found(df: DataFrame, **said) -> dict:
    results = rows(df)
    return said | {"results": results, "total_results": len(results)}


def _number(given: dict, name: str) -> int | None:
    return int(given[name]) if given.get(name) else None


ROUTES = {
    r"/": lambda e, g: {"service": "quire", "routes": sorted(ROUTES)},
    r"/health": lambda e, g: {"stages": {r["stage"]: r["ready"] for r in rows(e.health())}},
    r"/stats": lambda e, g: _one(e.stats()) | {"processing": _one(e.processing())},
    r"/search": lambda e, g: _found(e.search(g["q"], _number(g, "top_k")), query=g["q"]),
    r"/similar/(?P<pmid>[^/]+)": lambda e, g: _found(e.similar(g["pmid"], _number(g, "top_k")), pmid=g["pmid"]),
    r"/paper/(?P<pmid>[^/]+)": lambda e, g: _one(e.paper(g["pmid"])),
    r"/paper/(?P<pmid>[^/]+)/summary": lambda e, g: _one(e.paper_summary(g["pmid"])),
    r"/summarize": lambda e, g: _one(e.summarize(g["q"], _number(g, "top_k"))),
    r"/trending": lambda e, g: _found(e.trending_topics(_number(g, "top_k"), g.get("window", "month"))),
    r"/topic/(?P<topic_id>-?\d+)": lambda e, g: _one(e.topic(int(g["topic_id"]))),
    r"/topic/(?P<topic_id>-?\d+)/timeline": lambda e, g: _found(e.topic_timeline(int(g["topic_id"]), g.get("window", "month"))),
    r"/trends": lambda e, g: _one(e.general_trends()),
    r"/visualizations": lambda e, g: {name: rows(df) for name, df in e.visualizations(g.get("window", "month")).items()},
}


def answer(engine: Engine, route: str, **given) -> tuple[int, str]:
    """(status, JSON): 200, 400 without a needed value, 404 for an unknown route, paper or topic, 503 before the stages are there."""
    for pattern, reply in ROUTES.items():
        m = re.fullmatch(pattern, route)
        if not m:
            continue
        try:
            status, body = 200, reply(engine, given | m.groupdict())
        except NotReady as stage:
            status, body = 503, {"detail": f"not ready: {stage}"}
        except NotFound as name:
            status, body = 404, {"detail": f"not found: {name}"}
        except (KeyError, ValueError) as value:
            status, body = 400, {"detail": f"missing or wrong: {value}"}
        return status, json.dumps(body, default=str)
    return 404, json.dumps({"detail": f"no route {route}"})
