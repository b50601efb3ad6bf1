"""Topics: assignment, keywords, periods and growth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.functions import dates
from quire.functions import vectors as V
from quire.functions.text import let, tokens
from quire.storage import written

# Common English words that are no keywords.
STOP_WORDS = (
    "about above after again all also an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here him his how if in "
    "into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we "
    "were what when where which while who whom why will with would you your"
).split()


def period_counts(assigned: DataFrame, window: str = "month", date_col: str = "date") -> DataFrame:
    """assigned (topic_id, date) to (topic_id, period, count); period is the start of its bucket."""
    start = dates.bucket(F.col(date_col), window)
    return assigned.filter(F.col(date_col).isNotNull()).groupBy("topic_id", start.alias("period")).agg(F.count("*").alias("count"))


def topic_trends(assigned: DataFrame, window: str = "month", date_col: str = "date", outlier=-1) -> DataFrame:
    """Topics of two observed periods or more: growth of the last over the one before, scored by ln(mean + 1); with the series."""
    counts = period_counts(assigned, window, date_col).filter(F.col("topic_id") != outlier)
    series = F.array_sort(F.collect_list(F.struct("period", "count")))  # as long as there are periods
    rows = counts.groupBy("topic_id").agg(series.alias("s"), F.avg("count").alias("avg_count")).filter(F.size("s") >= 2)
    recent, previous = F.element_at("s", -1)["count"], F.element_at("s", -2)["count"]
    grown = rows.withColumn("growth_rate", (recent - previous) / F.greatest(previous, F.lit(1))).withColumn("recent_count", recent)
    return grown.select(
        "topic_id",
        "growth_rate",
        (F.col("growth_rate") * F.log1p("avg_count")).alias("growth_score"),
        "recent_count",
        "avg_count",
        F.transform("s", lambda x: F.struct(dates.bucket_label(x["period"], window).alias("time_period"), x["count"].alias("count"))).alias("time_series"),
    )


def trending(trends: DataFrame, k: int = 10) -> DataFrame:
    return trends.orderBy(F.desc("growth_score"), "topic_id").limit(k)


def timeline(trends: DataFrame, topic_id) -> DataFrame:
    return trends.filter(F.col("topic_id") == topic_id).select("topic_id", F.explode("time_series").alias("p")).select("topic_id", "p.time_period", "p.count")


def date_range(assigned: DataFrame, date_col: str = "date") -> DataFrame:
    """First and last day of all dated rows, outliers among them."""
    return assigned.agg(F.date_format(F.min(date_col), "yyyy-MM-dd").alias("start"), F.date_format(F.max(date_col), "yyyy-MM-dd").alias("end"))


def terms(text: Column, ngrams: int = 1, stop_words: bool = True) -> Column:
    """Words without stop words, then their runs of up to ngrams words."""
    words = F.filter(tokens(text), lambda w: ~w.isin(*STOP_WORDS)) if stop_words else tokens(text)
    if ngrams == 1:
        return words
    runs = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return let(words, lambda w: F.concat(w, *(runs(w, n) for n in range(2, ngrams + 1))))


def vocabulary(rows: DataFrame, ngrams: int = 2, min_df: int = 2, size: int = 1000, text_col: str = "text_content", stop_words: bool = True) -> DataFrame:
    """(word, count, df) of the most frequent terms that min_df rows or more hold; ties by word."""
    return vocabulary_of(rows.select("pmid", terms(F.col(text_col), ngrams, stop_words).alias("t")), rows.select("pmid"), min_df, size)


def _exploded(texts: DataFrame) -> DataFrame:
    """(word, n, df) of texts (t): a row a word, and one for each different word of a text."""
    share = lambda array, n, df: F.transform(array, lambda w: F.struct(w.alias("word"), F.lit(n).cast("long").alias("n"), F.lit(df).cast("long").alias("df")))
    return texts.select(F.explode(F.concat(share(F.col("t"), 1, 0), share(F.array_distinct("t"), 0, 1))).alias("w")).select("w.*")


def vocabulary_of(found: DataFrame, ids: DataFrame, min_df: int, size: int, each: Callable[[DataFrame], DataFrame] = _exploded) -> DataFrame:
    """``vocabulary`` of texts that are terms already: found (pmid, t), with ids (pmid) of the same rows.  ``each``: what counts the terms of rows that are texts."""
    again = written(ids.groupBy("pmid").agg(F.count("*").alias("n")).filter("n > 1 or pmid is null").select("pmid"), "repeated-ids")  # ids are shuffled, no texts
    if again.isEmpty():
        counted = each(found)  # a row is a text: terms are counted before anything is shuffled
    else:
        one, many = found.join(again, "pmid", "left_anti").filter("pmid is not null"), found.join(again, found["pmid"].eqNullSafe(again["pmid"]), "left_semi")
        held = many.select("pmid", F.explode("t").alias("word")).groupBy("word", "pmid").agg(F.count("*").alias("n"))
        counted = each(one).unionByName(held.select("word", "n", F.lit(1).cast("long").alias("df")))
    return counted.groupBy("word").agg(F.sum("n").alias("count"), F.sum("df").alias("df")).filter(F.col("df") >= min_df).orderBy(F.desc("count"), "word").limit(size)


def ctfidf(rows: DataFrame, k: int = 10, topic_col: str = "topic_id", text_col: str = "text_content", stop_words: bool = True, min_count: int = 2, ngrams: int = 1, words: DataFrame | None = None) -> DataFrame:
    """Class-based tf-idf: share of a token in a topic times ln(1 + mean tokens a topic / corpus count).  The k best of each topic, ties by word.  ``words``: a vocabulary to keep to."""
    found = rows.select(F.col(topic_col).alias("topic_id"), F.explode(terms(F.col(text_col), ngrams, stop_words)).alias("word"))
    if words is not None:
        found = found.join(words.select("word"), "word", "left_semi")
    counts = written(found.groupBy("topic_id", "word").agg(F.count("*").alias("n")), "term-counts")  # read four times; the texts once
    totals = counts.groupBy("topic_id").agg(F.sum("n").alias("topic_n"))
    mean = totals.agg(F.avg("topic_n").alias("mean_n"))  # one row
    corpus = counts.groupBy("word").agg(F.sum("n").alias("corpus_n")).filter(F.col("corpus_n") >= min_count)
    scored = counts.join(corpus, "word").join(totals, "topic_id").crossJoin(mean).select("topic_id", "word", (F.col("n") / F.col("topic_n") * F.log1p(F.col("mean_n") / F.col("corpus_n"))).alias("score"))
    best = Window.partitionBy("topic_id").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def topic_labels(keywords: DataFrame, n: int = 3) -> DataFrame:
    first = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return keywords.filter(F.col("rank") <= n).groupBy("topic_id").agg(F.array_join(F.transform(first, lambda x: x["word"]), ", ").alias("topic_label"))


def fit_kmeans(vectors: DataFrame, k: int = 50, seed: int = 42, runs: int = 1, vector_col: str = "embedding", reduce_to: int | None = None) -> PipelineModel:
    """The best of ``runs`` seeds by training cost; reduce_to: principal components to cluster in."""
    data = vectors.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    before = []
    if reduce_to:
        before = [PCA(k=reduce_to, inputCol="features", outputCol="reduced").fit(data)]
        data = before[0].transform(data).select("reduced")
    data = data.persist()  # each run reads it again
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="reduced" if reduce_to else "features", predictionCol="topic_id").fit(data) for i in range(runs)]
    finally:
        data.unpersist()
    return PipelineModel([*before, min(models, key=lambda m: m.summary.trainingCost)])


def assign_topics(vectors: DataFrame, model: PipelineModel, min_size: int = 1, vector_col: str = "embedding") -> DataFrame:
    """(pmid, topic_id, topic_probability): nearest centre, softmax of negative squared distances; topics under min_size become -1."""
    kmeans = model.stages[-1]
    centres = F.lit([[float(x) for x in c] for c in kmeans.clusterCenters()])
    rows = vectors.select("pmid", array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    for stage in model.stages[:-1]:
        rows = stage.transform(rows)
    rows = rows.select("pmid", vector_to_array(kmeans.getFeaturesCol()).alias("v"))
    distance = F.transform(centres, lambda c: F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
    scored = rows.select("pmid", distance.alias("d")).withColumn("least", F.array_min("d"))
    own = scored.select("pmid", (F.array_position("d", F.col("least")) - 1).cast("int").alias("topic_id"), (1 / F.aggregate("d", F.lit(0.0), lambda s, x: s + F.exp(F.col("least") - x))).alias("topic_probability"))
    if min_size <= 1:
        return own
    small = own.groupBy("topic_id").agg(F.count("*").alias("n")).filter(F.col("n") < min_size)  # under k rows
    return own.join(F.broadcast(small), "topic_id", "left").select("pmid", F.when(F.col("n").isNull(), F.col("topic_id")).otherwise(-1).alias("topic_id"), "topic_probability")


def topic_centres(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """(topic_id, centre): mean vectors of topics."""
    rows = vectors.join(assigned.select("pmid", "topic_id"), "pmid").select("topic_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return rows.groupBy("topic_id").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("centre"))


def rerank_keywords(keywords: DataFrame, word_vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Keywords of each topic by the cosine of word and topic; word_vectors (word, embedding), centres (topic_id, centre).  Words without one come last."""
    score = F.coalesce(V.cosine(F.col("embedding"), F.col("centre")), F.lit(-1.0))
    rows = keywords.join(word_vectors, "word", "left").join(centres, "topic_id", "left").select("topic_id", "word", score.alias("score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), "word")))


def topic_info(assigned: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    info = assigned.groupBy("topic_id").agg(F.count("*").alias("count"))
    return info if labels is None else info.join(labels, "topic_id", "left")


def topic_papers(papers: DataFrame, assigned: DataFrame, topic_id, num_papers: int = 10) -> DataFrame:
    """A topic's papers by probability, ties by id."""
    own = assigned.filter(F.col("topic_id") == topic_id).select("pmid", "topic_id", "topic_probability")
    return papers.join(own.orderBy(F.desc("topic_probability"), "pmid").limit(num_papers), "pmid").orderBy(F.desc("topic_probability"), "pmid")


def topic_terms(papers: DataFrame, assigned: DataFrame, topic_id, k: int = 10) -> DataFrame:
    own = papers.join(assigned.filter(F.col("topic_id") == topic_id).select("pmid"), "pmid").select(F.explode("mesh_terms").alias("term"))
    return own.groupBy("term").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "term").limit(k)


def topic_details(papers: DataFrame, assigned: DataFrame, keywords: DataFrame, topic_id, num_papers: int = 10) -> DataFrame:
    """One row for a topic that has papers: keywords, size, top papers, top terms, label; no row for an unknown one."""
    n = assigned.filter(F.col("topic_id") == topic_id).agg(F.count("*").alias("num_papers")).filter("num_papers > 0")
    words = keywords.filter(F.col("topic_id") == topic_id)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "word", "score")))
    one = words.agg(F.transform(ordered, lambda x: F.struct(x["word"].alias("word"), x["score"].alias("score"))).alias("keywords"))
    top = topic_papers(papers, assigned, topic_id, num_papers).agg(F.sort_array(F.collect_list(F.struct((-F.col("topic_probability")).alias("o"), F.col("pmid")))).alias("t")).select(F.transform("t", lambda x: F.struct(x["pmid"].alias("pmid"), (-x["o"]).alias("topic_probability"))).alias("top_papers"))
    terms = topic_terms(papers, assigned, topic_id).agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "term"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["term"].alias("term"), (-x["o"]).alias("count"))).alias("top_mesh_terms"))
    label = F.array_join(F.slice(F.transform("keywords", lambda x: x["word"]), 1, 3), ", ")
    return n.crossJoin(one).crossJoin(top).crossJoin(terms).select(F.lit(topic_id).alias("topic_id"), "keywords", "num_papers", "top_papers", "top_mesh_terms", label.alias("topic_label"))  # one row each


def topic_keywords(papers: DataFrame, vectors: DataFrame, assigned: DataFrame, embed, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(topic_id, word, score, rank): of the class-based tf-idf's best words and word pairs of the vocabulary those nearest to the topic's mean vector.  embed: papers to vectors."""
    words = vocabulary(papers, 2, 2, config.vocabulary_size)
    found = ctfidf(papers.join(assigned.select("pmid", "topic_id"), "pmid"), config.keyword_candidates, min_count=1, ngrams=2, words=words)
    texts = found.select(F.col("word").alias("pmid"), F.col("word").alias("text_content")).distinct()
    ranked = rerank_keywords(found, embed(texts).withColumnRenamed("pmid", "word"), topic_centres(vectors, assigned))
    return ranked.filter(F.col("rank") <= config.keywords)


def fit_topics(papers: DataFrame, vectors: DataFrame, embed, config: EngineConfig = EngineConfig()) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(model, assignments, keywords) of papers with a text."""
    model = fit_kmeans(vectors, config.num_topics, config.seed, config.topic_runs, reduce_to=min(config.topic_components, config.vector_dim))
    assigned = assign_topics(vectors, model, config.min_topic_size)
    return model, assigned, topic_keywords(papers, vectors, assigned, embed, config)
