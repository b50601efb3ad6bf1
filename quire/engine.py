"""One object with the whole service surface; every answer is a DataFrame."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.functions import dates
from quire.functions.sentences import train
from quire.operators import charts, density, hierarchy, latent, mixtures, prepare, search, stats, summaries, topics, trends
from quire.operators.vector_index import VectorIndex
from quire.schemas import RAW_PAPER
from quire.sources import remote, tables


class NotFound(LookupError):
    """A paper or topic that is not there."""


class NotReady(RuntimeError):
    """A stage that has not run."""


class Engine:
    """Stages are Parquet tables below ``home``: built when missing, again with refresh."""

    def __init__(self, spark: SparkSession, home: str, config: EngineConfig = EngineConfig()):
        self.spark, self.home, self.config = spark, home.rstrip("/"), config

    # stages

    def _path(self, name: str) -> str:
        return f"{self.home}/{name}"

    def _table(self, name: str) -> DataFrame:
        if not tables.ready(self.spark, self._path(name)):
            raise NotReady(name)
        return self.spark.read.parquet(self._path(name))

    def ingest(self, *domains: DataFrame, dedup: bool = True, refresh: bool = False) -> DataFrame:
        return tables.materialise(self.spark, self._path("raw_papers"), lambda: tables.union_domains(domains, dedup), refresh)

    def ingest_jsonl(self, path: str, refresh: bool = False) -> DataFrame:
        return self.ingest(tables.read_jsonl(self.spark, path, RAW_PAPER), refresh=refresh)

    def ingest_remote(self, url: str, refresh: bool = False, **options: str) -> DataFrame:
        """All domains of the configuration from an article service; a paper found in two stays once."""
        remote.register(self.spark)
        c = self.config
        own = {"url": url, "date_from": c.date_from, "date_to": c.date_to, "max_results": str(c.papers_per_domain)} | options
        return self.ingest(*(self.spark.read.format("articles").options(**own, term=d).load() for d in c.domains), refresh=refresh)

    def run_pipeline(self, refresh: bool = False) -> DataFrame:
        """Preprocess, embed, summarise, and fit topics over the ingested papers; the stages and whether each is there."""
        t = lambda name, build: tables.materialise(self.spark, self._path(name), build, refresh)
        raw = self._table("raw_papers")
        if refresh or not tables.ready(self.spark, self._path("processed_papers")):
            splitter = train(raw, "abstract") if self.config.sentence_splitter == "trained" else None
            done, counts = prepare.process_valid(raw, self.config, splitter)
            tables.write_parquet(done, self._path("processed_papers"))
            seen, kept = counts.get["seen"], counts.get["processed"]
            tables.write_parquet(self.spark.createDataFrame([(seen, kept, seen - kept)], "seen long, processed long, skipped long"), self._path("processing"))
        papers = self.papers()
        if refresh or not tables.ready(self.spark, self._path(self._embedder_stage)):
            if self.config.embedding == "latent":
                latent.LatentEmbedder(self.config).fit(papers).save(self.spark, self._path("latent_embedder"))
            else:
                search.Embedder(self.config).fit(papers).model.write().overwrite().save(self._path("embedder"))
                tables.finish(self.spark, self._path("embedder"))
        vectors = t("embeddings", lambda: self.embedder().embed(papers))
        if refresh or not tables.ready(self.spark, self._path("vector_index/meta")):
            VectorIndex.build(vectors, self._path("vector_index"), recall=self.config.index_recall, k=self.config.top_k, seed=self.config.seed)
        t("summaries", lambda: summaries.summarize_papers(papers, config=self.config))
        assigned = t("topic_assignments", lambda: self._assigned(vectors, refresh))
        t("topic_keywords", lambda: topics.topic_keywords(papers, vectors, assigned, self.embedder().embed, self.config))
        return self.health()

    def _assigned(self, vectors: DataFrame, refresh: bool) -> DataFrame:
        """Topics of the papers by the configured method: a kept k-means model, or density clusters."""
        c = self.config
        if c.topic_method == "density":
            return density.density_clusters(vectors, c.min_topic_size, components=min(c.topic_components, c.vector_dim))
        if refresh or not tables.ready(self.spark, self._path("topic_model")):
            topics.fit_kmeans(vectors, c.num_topics, c.seed, c.topic_runs, reduce_to=min(c.topic_components, c.vector_dim)).write().overwrite().save(self._path("topic_model"))
            tables.finish(self.spark, self._path("topic_model"))
        return topics.assign_topics(vectors, PipelineModel.load(self._path("topic_model")), c.min_topic_size)

    def health(self) -> DataFrame:
        """The stages and whether each is there."""
        names = ("raw_papers", "processed_papers", "embeddings", "summaries", "topic_assignments", "topic_keywords")
        return self.spark.createDataFrame([(n, tables.ready(self.spark, self._path(n))) for n in names], "stage string, ready boolean")

    # tables

    def processing(self) -> DataFrame:
        """One row: papers seen, processed and skipped."""
        return self._table("processing")

    def papers(self) -> DataFrame:
        return self._table("processed_papers")

    def vectors(self) -> DataFrame:
        return self._table("embeddings")

    def index(self) -> VectorIndex:
        if not tables.ready(self.spark, self._path("vector_index/meta")):
            raise NotReady("vector_index")
        return VectorIndex.open(self.spark, self._path("vector_index"))

    @property
    def _embedder_stage(self) -> str:
        return "latent_embedder" if self.config.embedding == "latent" else "embedder"

    def embedder(self) -> search.Embedder | latent.LatentEmbedder:
        if self.config.embedding == "latent":
            return latent.LatentEmbedder.load(self.spark, self._path("latent_embedder"), self.config)
        return search.Embedder(self.config, PipelineModel.load(self._path("embedder")))

    def assignments(self) -> DataFrame:
        return self._table("topic_assignments")

    def keywords(self) -> DataFrame:
        return self._table("topic_keywords")

    # queries

    def stats(self) -> DataFrame:
        return stats.corpus_stats(self.papers()).crossJoin(stats.embedding_stats(self.vectors()))  # one row each

    def search(self, query: str, top_k: int | None = None, exact: bool = True) -> DataFrame:
        """The papers nearest to the query; with ``exact`` unset only the index's nearest buckets are read."""
        vector = self.embedder().embed_text(self.spark, query)
        hits = search.top_k(self.vectors(), vector, top_k, self.config.top_k) if exact else self.index().search(vector, top_k or self.config.top_k)
        return search.with_payload(hits, self.papers())

    def paper(self, pmid: str) -> DataFrame:
        found = prepare.paper(self.papers(), pmid)
        if found.isEmpty():
            raise NotFound(pmid)
        return found

    def similar(self, pmid: str, top_k: int | None = None, exact: bool = True) -> DataFrame:
        hits = search.similar(self.vectors(), pmid, top_k, self.config.top_k) if exact else self.index().similar(pmid, top_k or self.config.top_k)
        return search.with_payload(hits, self.papers())

    def summarize(self, query: str, top_k: int | None = None) -> DataFrame:
        """One summary of the papers found; the query is its topic."""
        hits = self.search(query, top_k or self.config.summary_top_k)
        done = summaries.multi_paper_summary(hits, [-F.col("similarity_score"), F.col("pmid")], query, self.config)
        return done.withColumn("query", F.lit(query))

    def paper_summary(self, pmid: str, query: str | None = None) -> DataFrame:
        """A paper's summary; with a query its sentences nearest to it, by vectors where they are latent, else by words."""
        if query is not None and self.config.embedding == "latent":
            return summaries.semantic_summary(self.paper(pmid), self.embedder(), query, config=self.config)
        return summaries.add_summary(self.paper(pmid), query=query, config=self.config)

    def _dated(self) -> DataFrame:
        return self.assignments().join(self.papers().select("pmid", dates.as_date(F.col("pub_date")).alias("date")), "pmid")

    def topic_trends(self, window: str = "month") -> DataFrame:
        labels = topics.topic_labels(self.keywords())
        return topics.topic_trends(self._dated(), window).join(labels, "topic_id", "left")

    def trending_topics(self, top_k: int | None = None, window: str = "month") -> DataFrame:
        return topics.trending(self.topic_trends(window), top_k or self.config.top_k)

    def topic(self, topic_id: int, num_papers: int = 10) -> DataFrame:
        found = topics.topic_details(self.papers(), self.assignments(), self.keywords(), topic_id, num_papers)
        if found.isEmpty():
            raise NotFound(topic_id)
        return found

    def topic_timeline(self, topic_id: int, window: str = "month") -> DataFrame:
        return topics.timeline(self.topic_trends(window), topic_id)

    def topic_distribution(self, pmid: str) -> DataFrame:
        """A paper's shares of all topics, the greatest first."""
        centres = topics.topic_centres(self.vectors(), self.assignments().filter(F.col("topic_id") != density.OUTLIER))
        return mixtures.soft_assignments(self.vectors().filter(F.col("pmid") == pmid), centres).orderBy(F.desc("probability"), "topic_id")

    def topic_hierarchy(self) -> DataFrame:
        return hierarchy.topic_hierarchy(self.vectors(), self.assignments())

    def topic_map(self) -> DataFrame:
        return hierarchy.topic_map(self.vectors(), self.assignments()).join(topics.topic_labels(self.keywords()), "topic_id", "left")

    def topic_info(self) -> DataFrame:
        return topics.topic_info(self.assignments(), topics.topic_labels(self.keywords()))

    def general_trends(self) -> DataFrame:
        return trends.research_trends(self.papers())

    def trending_summaries(self, window: str = "month", num_papers: int = 3) -> DataFrame:
        """A summary of the top papers of the most trending topic."""
        top = self.trending_topics(1, window).first()
        if top is None:
            return self.spark.createDataFrame([], "summary string, error string, original_length int, summary_length int, compression_ratio double, source_papers array<string>, num_papers int")
        rows = topics.topic_papers(self.papers(), self.assignments(), top["topic_id"], num_papers)
        return summaries.multi_paper_summary(rows, [-F.col("topic_probability"), F.col("pmid")], top["topic_label"], self.config)

    def visualizations(self, window: str = "month") -> dict[str, DataFrame]:
        """Chart-ready tables by name; drawing them is the caller's."""
        t = self.topic_trends(window)
        papers = self.papers()
        return {
            "trend_lines": charts.trend_lines(t),
            "growth_bars": charts.growth_bars(t.drop("topic_label"), topics.topic_labels(self.keywords())),
            "topic_similarity": charts.topic_similarity(self.vectors(), self.assignments()),
            "topic_map": self.topic_map(),
            "topic_hierarchy": self.topic_hierarchy(),
            "years": trends.yearly_counts(papers),
            "journals": trends.top_journals(papers),
            "terms": stats.term_histogram(papers, 15),
            "team_sizes": trends.team_sizes(papers),
        }
