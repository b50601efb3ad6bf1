"""python -m quire COMMAND HOME [ARGUMENT ...]

setup HOME FILES (JSON lines), check, search WORDS, summary WORDS, topics, trends, stats, get ROUTE [name=value ...] (JSON),
demo-search, demo-summary, demo-topics.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quire import edge
from quire.config import EngineConfig
from quire.engine import Engine

#: What the demonstrations ask.
QUESTIONS = ("vaccine efficacy", "cancer immunotherapy", "diabetes treatment", "disease biomarkers")


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    command, home, rest = args[0], args[1], args[2:]
    spark = SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, home, EngineConfig.from_env())
    if command == "setup":
        engine.ingest_jsonl(rest[0])
        engine.run_pipeline().show()
        return 0
    if command == "get":
        status, body = edge.answer(engine, rest[0], **dict(x.split("=", 1) for x in rest[1:]))
        print(body)
        return 0 if status == 200 else 1
    hits = lambda q, k=None: engine.search(q, k).select("pmid", "title", "similarity_score")
    commands = {
        "check": lambda: [engine.health()],
        "search": lambda: [hits(" ".join(rest))],
        "summary": lambda: [engine.summarize(" ".join(rest))],
        "topics": lambda: [engine.trending_topics().drop("time_series")],
        "trends": lambda: [engine.general_trends()],
        "stats": lambda: [engine.stats()],
        "demo-search": lambda: [hits(q, 3) for q in QUESTIONS],
        "demo-summary": lambda: [engine.summarize(q, 3).select("query", "summary", "num_papers") for q in QUESTIONS[:2]],
        "demo-topics": lambda: [engine.topic_info(), engine.trending_topics(5).drop("time_series")],
    }
    if command not in commands:
        print(__doc__)
        return 2
    for df in commands[command]():
        df.show(truncate=100)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
