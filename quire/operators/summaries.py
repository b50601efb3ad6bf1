"""Extractive summaries of one or many papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.functions import text as T
from quire.functions.text import tokens
from quire.operators.graph_summary import graph_sentences
from quire.operators.prepare import with_text

TOO_SHORT = "Text too short for summarization"


def ranked_sentences(text: Column, query: str, n: int = 6) -> Column:
    """The n parts between '. ' that share most of the query's words, in document order; the whole text if it has no more."""
    wanted = F.array_distinct(tokens(F.lit(query)))
    score = lambda s: T.let(F.array_distinct(tokens(s)), lambda t: F.size(F.array_intersect(t, wanted)) / F.sqrt(F.greatest(F.size(t), F.lit(1))))

    def best(parts: Column) -> Column:
        scored = F.transform(parts, lambda s, i: F.struct((-score(s)).alias("o"), i.alias("i"), s.alias("s")))
        top = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, n), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
        return F.when(F.size(parts) <= n, text).otherwise(F.concat(F.array_join(F.transform(top, lambda x: x["s"]), ". "), F.lit(".")))

    return T.let(F.split(text, r"\. "), best)


def _at_most(text: Column, n: int) -> Column:
    return T.let(T.words(text), lambda w: F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(text))


def summary_text(text: Column, query: str | None = None, config: EngineConfig = EngineConfig()) -> Column:
    """Leading or query-ranked sentences, cut to the summary's words and to whole sentences."""
    picked = ranked_sentences(text, query, config.summary_sentences) if query else T.lead_sentences(text, config.summary_sentences)
    return T.post_process(T.let(picked, lambda x: _at_most(x, min(config.input_max_words, config.summary_max_words))))


def graph_summary_text(rows: DataFrame, text: Column, config: EngineConfig = EngineConfig()) -> DataFrame:
    """rows with ``summary``: the sentences that rank best in the text's sentence graph, the leading ones where none is long enough to be one."""
    most = min(config.input_max_words, config.summary_max_words)
    marked = rows.withColumn("_sentences", T.split_sentences(text, config.sentence_min_chars))
    best = graph_sentences(F.col("_sentences"), config.summary_sentences, most)
    whole = T.post_process(T.first_words(best, most))
    return marked.withColumn("summary", F.when(F.size("_sentences") > 0, whole).otherwise(summary_text(text, None, config))).drop("_sentences")


def semantic_summary(rows: DataFrame, embedder, query: str, text_col: str = "text_content", config: EngineConfig = EngineConfig()) -> DataFrame:
    """rows with ``summary``: the sentences whose vectors are nearest to the query's, in the text's order, cut to the summary's words.  Nothing is shuffled; ties go to the earlier sentence.

    embedder: one with sentence_cosines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    wanted = embedder.embed_text(rows.sparkSession, query)
    marked = rows.withColumn("_sentences", T.split_sentences(text, config.sentence_min_chars)).withColumn("_near", embedder.sentence_cosines(F.col("_sentences"), wanted))
    order = F.array_sort(F.transform("_near", lambda x, i: F.struct((-F.round(x, 9)).alias("far"), i.alias("i"))))
    best = F.array_sort(F.transform(F.slice(order, 1, config.summary_sentences), lambda x: x["i"]))
    said = F.array_join(F.transform(best, lambda i: F.get(F.col("_sentences"), i)), " ")
    return marked.withColumn("summary", F.when(F.size("_sentences") > 0, T.post_process(T.first_words(said, min(config.input_max_words, config.summary_max_words)))).otherwise("")).drop("_sentences", "_near")


def add_summary(rows: DataFrame, text_col: str = "text_content", query: str | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Adds summary, error, original_length, summary_length, compression_ratio; columns of those names are replaced.

    Sentences are taken by the query's words, or else by the configured method."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    short = F.char_length(T.strip(text)) < config.summary_min_chars
    if query is None and config.summary_method == "graph":
        out = graph_summary_text(rows, text, config)
        out = out.withColumn("summary", F.when(short, F.lit("")).otherwise(F.col("summary")))
    else:
        out = rows.withColumn("summary", F.when(short, F.lit("")).otherwise(summary_text(text, query, config)))
    return out.withColumns(
        {
            "error": F.when(short, F.lit(TOO_SHORT)),
            "original_length": F.when(~short, T.word_count(text)),
            "summary_length": F.when(~short, T.word_count(F.col("summary"))),
            "compression_ratio": F.when(~short, T.word_count(F.col("summary")) / T.word_count(text)),
        }
    )


def summarize_papers(papers: DataFrame, query: str | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    return add_summary(with_text(papers), query=query, config=config)


def combined_text(papers: DataFrame, order: list, topic: str | None = None) -> DataFrame:
    """One row: the papers' summaries, abstracts or first 200 words in order, joined; their ids; their number.  For a bounded number of papers."""
    full = lambda c: F.nullif(F.col(c), F.lit("")) if c in papers.columns else F.lit(None).cast("string")
    piece = F.coalesce(full("summary"), full("abstract"), T.first_words(full("text_content"), 200))
    rows = papers.select(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.nullif(piece, F.lit("")).alias("piece"), "pmid")
    all_rows = F.sort_array(F.collect_list(F.struct(*(f"o{i}" for i in range(len(order))), "pmid", "piece")))
    one = rows.agg(all_rows.alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["piece"]), " ")
    if topic:
        text = F.when(text != "", F.concat(F.lit(f"Topic: {topic}. Research findings: "), text)).otherwise("")
    return one.select(text.alias("text_content"), F.transform("r", lambda x: x["pmid"]).alias("source_papers"), F.size("r").alias("num_papers"))


def multi_paper_summary(papers: DataFrame, order: list, topic: str | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row; with an error instead of a summary where there is no paper or no text."""
    one = add_summary(combined_text(papers, order, topic), query=topic, config=config)
    error = F.when(F.col("num_papers") == 0, "No papers provided").when(F.col("text_content") == "", "No text content found").otherwise(F.col("error"))
    return one.select("summary", error.alias("error"), "original_length", "summary_length", "compression_ratio", "source_papers", "num_papers")
