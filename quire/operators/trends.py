"""Publication, journal, subject-term and author trends.  A previous period is the previous observed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import dates
from quire.operators.stats import exploded, histogram, term_histogram


def yearly_counts(papers: DataFrame, compat: bool = False) -> DataFrame:
    token = dates.year_token if compat else dates.year
    return papers.select(token(F.col("pub_date")).alias("year")).filter("year is not null").groupBy("year").agg(F.count("*").alias("count"))


def monthly_counts(papers: DataFrame, compat: bool = False) -> DataFrame:
    key = dates.month_key_compat if compat else dates.month_key
    return papers.select(key(F.col("pub_date")).alias("month")).filter("month is not null").groupBy("month").agg(F.count("*").alias("count"))


def time_summary(papers: DataFrame, compat: bool = False) -> DataFrame:
    """One row: growth of the last year over the one before (0 with fewer), the peak year (the earliest of equals), years."""
    years = F.array_sort(F.collect_list(F.struct("year", "count")))
    one = yearly_counts(papers, compat).agg(years.alias("y"))  # one entry a year
    last, before = F.get("y", F.size("y") - 1)["count"], F.get("y", F.size("y") - 2)["count"]
    peak = F.array_max(F.transform("y", lambda x: x["count"]))
    return one.select(
        F.when(F.size("y") >= 2, (last - before) / F.greatest(before, F.lit(1))).otherwise(0.0).alias("annual_growth_rate"),
        F.get(F.filter("y", lambda x: x["count"] == peak), F.lit(0))["year"].alias("peak_year"),
        F.size("y").cast("long").alias("total_years"),
    )


def journal_summary(papers: DataFrame) -> DataFrame:
    """Journals, and journals with more than one paper."""
    return histogram(papers, "journal").agg(F.count("*").alias("total_journals"), F.count_if(F.col("count") > 1).alias("journal_diversity"))


def top_journals(papers: DataFrame, k: int = 10) -> DataFrame:
    return histogram(papers, "journal", k=k)


def term_year_counts(papers: DataFrame) -> DataFrame:
    rows = exploded(papers, "mesh_terms", "term").withColumn("year", dates.year(F.col("pub_date"))).filter("year is not null")
    return rows.groupBy("term", "year").agg(F.count("*").alias("count"))


def term_growth(papers: DataFrame, least_recent: int = 3) -> DataFrame:
    """Terms of two years or more: the last year's count against the mean of the earlier ones; their counts over all papers, undated ones too."""
    by_term = Window.partitionBy("term")
    counts = exploded(papers, "mesh_terms", "term").groupBy("term", dates.year(F.col("pub_date")).alias("year")).agg(F.count("*").alias("count"))
    earlier = by_term.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # years in order, none first
    dated = F.when(F.col("year").isNotNull(), F.col("count"))
    rows = counts.select("term", "year", "count", F.avg(dated).over(earlier).alias("earlier"), F.max("year").over(by_term).alias("last"), F.sum("count").over(by_term).alias("total_count"))
    last = rows.filter((F.col("year") == F.col("last")) & F.col("earlier").isNotNull() & (F.col("count") >= least_recent))
    return last.select("term", ((F.col("count") - F.col("earlier")) / F.greatest("earlier", F.lit(1.0))).alias("growth_rate"), F.col("count").alias("recent_count"), "total_count")


def growing_terms(papers: DataFrame, k: int = 10) -> DataFrame:
    return term_growth(papers).orderBy(F.desc("growth_rate"), "term").limit(k)


def author_counts(papers: DataFrame, k: int | None = None) -> DataFrame:
    """Papers of each author; a name twice in one paper counts twice."""
    return histogram(exploded(papers, "authors", "author"), "author", k=k).withColumnRenamed("count", "paper_count")


def collaboration(papers: DataFrame) -> DataFrame:
    """One row of team sizes over papers with an author; no row if there are none."""
    each = papers.select(F.size("authors").alias("n"), F.posexplode("authors").alias("i", "author"))
    team = F.when(F.col("i") == 0, F.col("n"))  # once a paper
    found = each.agg(
        F.avg(team).alias("avg_authors_per_paper"),
        F.max(team).alias("max_authors_per_paper"),
        F.count_if(team == 1).alias("single_author"),
        F.count_if(team.between(2, 5)).alias("small_team"),
        F.count_if(team > 5).alias("large_team"),
        F.count_distinct("author").alias("total_unique_authors"),
    )
    return found.filter("max_authors_per_paper is not null")


def team_sizes(papers: DataFrame) -> DataFrame:
    """(team, papers), three rows at most."""
    n = F.size("authors")
    kind = F.when(n == 1, "single_author").when(n <= 5, "small_team").otherwise("large_team")
    return papers.filter(n > 0).groupBy(kind.alias("team")).agg(F.count("*").alias("papers"))


def research_trends(papers: DataFrame) -> DataFrame:
    """The four blocks and the total as one row of structs."""

    def block(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct("*").alias(name))

    def listed(df: DataFrame, name: str, *order) -> DataFrame:
        rows = df.agg(F.sort_array(F.collect_list(F.struct(*order, F.struct("*").alias("row")))).alias("r"))
        return rows.select(F.transform("r", lambda x: x["row"]).alias(name))

    down = lambda c: (-F.col(c)).alias("_o")
    blocks = [
        block(time_summary(papers).crossJoin(yearly_counts(papers).agg(F.map_from_entries(F.collect_list(F.struct("year", "count"))).alias("yearly_counts"))).crossJoin(monthly_counts(papers).agg(F.map_from_entries(F.collect_list(F.struct("month", "count"))).alias("monthly_counts"))), "time_trends"),
        block(journal_summary(papers).crossJoin(listed(top_journals(papers), "top_journals", down("count"), "journal")), "journal_trends"),
        block(term_histogram(papers).agg(F.count("*").alias("total_unique_terms")).crossJoin(listed(term_histogram(papers, 20), "top_mesh_terms", down("count"), "term")).crossJoin(listed(growing_terms(papers), "growing_mesh_terms", down("growth_rate"), "term")), "mesh_trends"),
        block(collaboration(papers).crossJoin(listed(author_counts(papers, 10), "top_authors", down("paper_count"), "author")), "collaboration_trends"),
    ]
    out = papers.agg(F.count("*").alias("total_papers"))
    for b in blocks:
        out = out.join(b, how="left")  # one row each
    return out
