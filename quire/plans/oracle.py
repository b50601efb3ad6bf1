"""The queries' SQL for DuckDB, written from their definitions and not from the Spark plans."""

from __future__ import annotations

import unicodedata

from quire.operators.topics import STOP_WORDS
from quire.operators.vector_index import directions
from quire.plans.queries import CHUNK_WORDS, LSH_BITS, LSH_QUERIES, LSH_VISITS
from quire.plans.views import PAPERS_META, TOPIC_EVENTS, TOPIC_OUTLIERS, TOPIC_PAPERS

#: The accented letters of the test tables; DuckDB has no compatibility decomposition.
ACCENTED = "ÉÈÊéèêÇçÄäÖöÜüÍíÓóÑñ"


def _nfkd(x: str) -> str:
    for c in ACCENTED:
        x = f"replace({x}, '{c}', '{unicodedata.normalize('NFKD', c)}')"
    return x


def _collapse(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def _clean(x: str) -> str:
    x = _collapse(x)
    for pattern in (r"\[[\d\s,-]+\]", r"\([\d\s,-]+\)", r"©.*?\d{4}", r"doi:.*?\s"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        x = f"replace({x}, '{old}', '{new}')"
    return f"trim({_collapse(x)})"


def _words(x: str) -> str:
    return f"list_filter(string_split({_collapse(x)}, ' '), lambda w: w <> '')"


def _first_words(x: str, n: int) -> str:
    return f"coalesce(array_to_string({_words(x)}[1:{n}], ' '), '')"


def _sentences(x: str) -> str:
    marked = rf"""regexp_replace({_collapse(x)}, '([.!?])\s+([A-Z0-9"(])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {_clean('s')}), lambda s: length(s) > 20)"


def _chunks(sentences: str, most: int) -> str:
    count = f"len({_words('s')})::INTEGER"
    start = "{'ch': []::VARCHAR[], 'cur': []::VARCHAR[], 'n': 0::INTEGER, 'last': 0::INTEGER}"
    each = f"list_transform({sentences}, lambda s: {{'ch': []::VARCHAR[], 'cur': [s]::VARCHAR[], 'n': {count}, 'last': {count}}})"
    step = f"""CASE WHEN a.n + x.n > {most} AND len(a.cur) > 0
        THEN {{'ch': list_append(a.ch, array_to_string(a.cur, ' '))::VARCHAR[], 'cur': [a.cur[-1], x.cur[1]]::VARCHAR[], 'n': (a.last + x.n)::INTEGER, 'last': x.n::INTEGER}}
        ELSE {{'ch': a.ch::VARCHAR[], 'cur': list_append(a.cur, x.cur[1])::VARCHAR[], 'n': (a.n + x.n)::INTEGER, 'last': x.n::INTEGER}} END"""
    return f"list_reduce({each}, lambda a, x: {step}, {start})"


def _post(x: str) -> str:
    """Of a column x."""
    parts = f"string_split({x}, '. ')"
    kept = f"CASE WHEN len({parts}) > 1 AND NOT ends_with({parts}[-1], '.') THEN {parts}[1:len({parts}) - 1] ELSE {parts} END"
    joined = f"array_to_string({kept}, '. ')"
    ended = f"CASE WHEN ends_with({joined}, '.') THEN {joined} ELSE {joined} || '.' END"
    return f"regexp_replace(replace(replace({ended}, ' ..', '.'), '..', '.'), '^\\s+|\\s+$', '', 'g')"


META = f"WITH {PAPERS_META}"
DATED = "WITH papers AS (SELECT CAST(o_orderkey AS VARCHAR) AS pmid, strftime(o_orderdate, '%Y-%m-%d') AS pub_date FROM orders)"
YEARS = f"{DATED}, y AS (SELECT left(pub_date, 4) AS year, count(*) AS count FROM papers WHERE pub_date IS NOT NULL GROUP BY 1)"
DOCS = "SELECT CAST(doc_id AS VARCHAR) AS pmid, text AS abstract, source AS journal FROM documents"
VALID = r"length(regexp_replace(' ' || abstract, '^\s+|\s+$', '', 'g')) BETWEEN 50 AND 10000 AND abstract <> ''"
DOT = "list_inner_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = {})::DOUBLE[])"


def _trends(source: str, name: str, unit: str, label: str, outlier: str) -> str:
    return f"""WITH {source}, c AS (
      SELECT topic_id, date_trunc('{unit}', date) AS p, count(*) AS n FROM {name} WHERE date IS NOT NULL AND topic_id <> {outlier} GROUP BY 1, 2
    ), w AS (
      SELECT *, lag(n) OVER (PARTITION BY topic_id ORDER BY p) AS prev, row_number() OVER (PARTITION BY topic_id ORDER BY p DESC) AS back,
             avg(n) OVER (PARTITION BY topic_id) AS mean, count(*) OVER (PARTITION BY topic_id) AS periods FROM c
    ), s AS (
      SELECT topic_id, string_agg({label} || ':' || n, ',' ORDER BY p) AS series FROM c GROUP BY topic_id
    ), trends AS (
      SELECT w.topic_id, (n - prev) / greatest(prev, 1)::DOUBLE AS growth_rate, (n - prev) / greatest(prev, 1)::DOUBLE * ln(mean + 1) AS growth_score, n AS recent_count, mean AS avg_count, series
      FROM w JOIN s ON w.topic_id = s.topic_id WHERE back = 1 AND periods >= 2
    )"""


_MONTH, _YEAR, _QUARTER, _DAY = "strftime(p, '%Y-%m')", "strftime(p, '%Y')", "strftime(p, '%Y') || 'Q' || quarter(p)", "strftime(p, '%Y-%m-%d')"
_FLAT = "SELECT topic_id, round(growth_rate, 6) AS growth_rate, round(growth_score, 6) AS growth_score, recent_count, round(avg_count, 6) AS avg_count, series FROM trends"
_BY_MONTH = _trends(TOPIC_PAPERS, "topic_papers", "month", _MONTH, "-1")
_BY_YEAR = _trends(TOPIC_PAPERS, "topic_papers", "year", _YEAR, "-1")
_DOMAINS = "SELECT source AS journal, doc_id FROM documents WHERE coalesce(source < 'src5', true) UNION ALL SELECT source, doc_id FROM documents WHERE source >= 'src3'"
_CTFIDF = """WITH words AS (
  SELECT source AS topic_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')) AS word FROM documents
), n AS (SELECT topic_id, word, count(*) AS n FROM words GROUP BY 1, 2), t AS (SELECT topic_id, sum(n) AS topic_n FROM n GROUP BY 1),
f AS (SELECT word, sum(n) AS corpus_n FROM n GROUP BY 1 HAVING sum(n) >= 2),
scored AS (SELECT topic_id, word, n / topic_n::DOUBLE * ln(1 + (SELECT avg(topic_n) FROM t) / corpus_n::DOUBLE) AS score FROM n JOIN t USING (topic_id) JOIN f USING (word)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, word) AS rank FROM scored), best AS (SELECT * FROM ranked WHERE rank <= 10)"""


def _ranked(words: str, table: str, key: str = "source_papers") -> str:
    """CTEs up to q: table's rows with ``picked``, the six parts of abstract that share most of the words."""
    return f"""s AS (SELECT *, string_split(abstract, '. ') AS parts FROM {table}),
            e AS (SELECT {key}, i, parts[i] AS part, list_distinct(regexp_extract_all(lower(parts[i]), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')) AS t FROM s, range(1, len(parts) + 1) r(i)),
            w AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY len(list_intersect(t, [{words}])) / sqrt(greatest(len(t), 1)) DESC, i) AS place FROM e),
            b AS (SELECT {key}, string_agg(part, '. ' ORDER BY i) || '.' AS best FROM w WHERE place <= 6 GROUP BY 1),
            l AS (SELECT s.*, CASE WHEN len(parts) <= 6 THEN abstract ELSE best END AS led FROM s JOIN b USING ({key})),
            q AS (SELECT *, CASE WHEN len({_words('led')}) > 150 THEN {_first_words('led', 150)} ELSE led END AS picked FROM l)"""


def _low_words(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _rouge(n: int) -> str:
    """CTEs up to r{n}: (pmid, f) of the runs of n tokens of t's lists a and b."""
    run = " || ' ' || ".join("{0}[i + %d]" % k if k else "{0}[i]" for k in range(n))
    counted = lambda x: f"{x}{n} AS (SELECT pmid, {run.format(x)} AS g, count(*) AS n FROM t, range(1, greatest(len({x}) - {n - 2}, 1)) r(i) GROUP BY 1, 2), n{x}{n} AS (SELECT pmid, sum(n) AS n FROM {x}{n} GROUP BY 1)"
    return f"""{counted('a')}, {counted('b')},
            s{n} AS (SELECT pmid, sum(least(a{n}.n, b{n}.n)) AS s FROM a{n} JOIN b{n} USING (pmid, g) GROUP BY 1),
            r{n} AS (SELECT pmid, coalesce(2.0 * s / (na{n}.n + nb{n}.n), 0.0) AS f FROM t LEFT JOIN s{n} USING (pmid) LEFT JOIN na{n} USING (pmid) LEFT JOIN nb{n} USING (pmid))"""


def _lsh() -> str:
    planes = ", ".join(f"({i}, {[float(x) for x in p]}::DOUBLE[])" for i, p in enumerate(directions(64, LSH_BITS, 42).T))
    return f"""WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS pmid, embedding::DOUBLE[] AS e FROM embeddings), planes(bit, plane) AS (VALUES {planes}),
        centre AS (SELECT list(m ORDER BY i) AS centre FROM (SELECT i, avg(e[i]) AS m FROM v, range(1, 65) r(i) GROUP BY i)),
        p AS (SELECT pmid, bit, list_inner_product(e, plane) - list_inner_product(centre, plane) AS x FROM v, planes, centre),
        b AS (SELECT pmid, sum(CASE WHEN x > 0 THEN 1 << bit ELSE 0 END)::BIGINT AS bucket FROM p GROUP BY pmid),
        c AS (SELECT pmid AS query, n AS bucket, sum(CASE WHEN (x > 0) <> ((n >> bit) & 1 = 1) THEN x * x ELSE 0 END) AS cost FROM p, range({1 << LSH_BITS}) r(n) WHERE pmid IN {LSH_QUERIES} GROUP BY 1, 2),
        near AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY cost, bucket) <= {LSH_VISITS}),
        s AS (SELECT query, v.pmid, list_inner_product(v.e, q.e) AS score FROM near JOIN b USING (bucket) JOIN v ON v.pmid = b.pmid JOIN v q ON q.pmid = near.query)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, pmid) AS rank, pmid, round(score, 6) AS similarity_score FROM s QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    docs = f"({DOCS}) d"
    text = _clean(_nfkd("coalesce(abstract, '')"))
    content = f"regexp_replace(regexp_replace('. ' || {text}, '^\\s+|\\s+$', '', 'g'), '\\.$', '')"
    processed = f"WITH p AS (SELECT pmid, {text} AS abstract, {content} AS text_content, {_clean(_nfkd('journal'))} AS journal FROM {docs} WHERE {VALID}), s AS (SELECT *, {_sentences('text_content')} AS sentences FROM p)"
    raw_sentences = f"WITH s AS (SELECT pmid, {_sentences(_nfkd('abstract'))} AS sentences FROM {docs})"
    lead = "array_to_string(string_split(abstract, '. ')[1:6], '. ') || '.'"
    summary = _post("picked")
    return {
        "similar_topk": f"SELECT CAST(vec_id AS VARCHAR) AS pmid, round({DOT.format(0)}, 6) AS similarity_score FROM embeddings WHERE vec_id <> 0 ORDER BY {DOT.format(0)} DESC, pmid LIMIT 10",
        "search_topk_vec": f"SELECT CAST(vec_id AS VARCHAR) AS pmid, round({DOT.format(7)}, 6) AS similarity_score FROM embeddings ORDER BY {DOT.format(7)} DESC, pmid LIMIT 10",
        "lsh_topk": _lsh(),
        "topic_distribution": """WITH c AS (SELECT label AS topic_id, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
            d AS (SELECT CAST(vec_id AS VARCHAR) AS pmid, topic_id, sum((embedding[i]::DOUBLE - m) ** 2) AS d FROM embeddings JOIN c ON true GROUP BY 1, 2),
            w AS (SELECT *, exp(min(d) OVER (PARTITION BY pmid) - d) AS w FROM d)
            SELECT pmid, topic_id, round(w / sum(w) OVER (PARTITION BY pmid), 6) AS probability FROM w""",
        "author_sketches": f"{META}, a AS (SELECT left(pub_date, 4) AS period, unnest(authors) AS author FROM papers_meta), f AS (SELECT author, min(period) AS first FROM a GROUP BY 1), p AS (SELECT DISTINCT period FROM a) SELECT period, (SELECT count(*) FROM f WHERE first <= period) AS distinct_values FROM p",
        "author_sketch_range": f"{META}, a AS (SELECT left(pub_date, 4) AS period, unnest(authors) AS author FROM papers_meta) SELECT count(DISTINCT author) AS distinct_values, count(*) AS rows FROM a WHERE period BETWEEN '1994' AND '1996'",
        "density_neighbours": """WITH p AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal::DOUBLE / 100 AS x, s_nationkey::DOUBLE AS y FROM supplier),
            d AS (SELECT a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM p a JOIN p b ON a.id <> b.id)
            SELECT id, other, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, other) <= 5""",
        "topic_trends_outliers": f"{_trends(TOPIC_OUTLIERS, 'topic_outliers', 'quarter', _QUARTER, '-1')} {_FLAT}",
        "search_payload": f"SELECT CAST(vec_id AS VARCHAR) AS pmid, label AS topic_id, round({DOT.format(3)}, 6) AS similarity_score FROM embeddings WHERE vec_id <> 3 ORDER BY {DOT.format(3)} DESC, pmid LIMIT 5",
        "clean_text": f"SELECT pmid, {text} AS cleaned FROM {docs}",
        "clean_text_html": f"SELECT CAST(page_id AS VARCHAR) AS pmid, {_clean(_nfkd('html'))} AS cleaned FROM pages",
        "validate_filter": f"SELECT pmid, length(abstract)::BIGINT AS n_chars FROM {docs} WHERE {VALID}",
        "word_counts": f"SELECT pmid, len({_words('abstract')})::BIGINT AS n_words FROM {docs}",
        "sentences": f"{raw_sentences} SELECT pmid, (i - 1)::BIGINT AS i, sentences[i] AS sentence FROM s, range(1, len(sentences) + 1) r(i)",
        "chunks": f"{raw_sentences}, f AS (SELECT pmid, {_chunks('sentences', CHUNK_WORDS)} AS a FROM s), c AS (SELECT pmid, CASE WHEN len(a.cur) > 0 THEN list_append(a.ch, array_to_string(a.cur, ' ')) ELSE a.ch END AS chunks FROM f) SELECT pmid, (i - 1)::BIGINT AS i, chunks[i] AS chunk FROM c, range(1, len(chunks) + 1) r(i)",
        "process_projection": f"{processed}, f AS (SELECT *, {_chunks('sentences', CHUNK_WORDS)} AS a FROM s) SELECT pmid, '' AS title, abstract, text_content, journal, 'Unknown' AS pub_date, len({_words('text_content')})::BIGINT AS word_count, len(sentences)::BIGINT AS sentence_count, (len(a.ch) + CASE WHEN len(a.cur) > 0 THEN 1 ELSE 0 END)::BIGINT AS chunk_count, coalesce(array_to_string(sentences, '|'), '') AS sentences FROM f",
        "corpus_stats": f"{processed} SELECT count(*) AS total_papers, sum(len({_words('text_content')}))::BIGINT AS total_words, sum(len(sentences))::BIGINT AS total_sentences, round(avg(len({_words('text_content')})), 6) AS avg_words_per_paper, round(avg(len(sentences)), 6) AS avg_sentences_per_paper FROM s",
        "year_range": "SELECT min(year(o_orderdate))::INTEGER AS min_year, max(year(o_orderdate))::INTEGER AS max_year FROM orders",
        "journal_hist": f"{META} SELECT journal, count(*) AS count FROM papers_meta GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "term_hist": f"{META}, t AS (SELECT unnest(mesh_terms) AS term FROM papers_meta) SELECT term, count(*) AS count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
        "yearly_counts": f"{YEARS} SELECT year, count FROM y",
        "monthly_counts": f"{DATED} SELECT left(pub_date, 7) AS month, count(*) AS count FROM papers GROUP BY 1",
        "time_summary": f"{YEARS}, w AS (SELECT *, lag(count) OVER (ORDER BY year) AS prev FROM y) SELECT round((SELECT (count - prev) / greatest(prev, 1)::DOUBLE FROM w ORDER BY year DESC LIMIT 1), 6) AS annual_growth_rate, (SELECT year FROM y ORDER BY count DESC, year LIMIT 1) AS peak_year, (SELECT count(*) FROM y) AS total_years",
        "annual_growth": f"{YEARS}, w AS (SELECT *, lag(count) OVER (ORDER BY year) AS prev FROM y) SELECT round((count - prev) / greatest(prev, 1)::DOUBLE, 6) AS annual_growth_rate FROM w ORDER BY year DESC LIMIT 1",
        "peak_year": f"{YEARS} SELECT year AS peak_year FROM y ORDER BY count DESC, year LIMIT 1",
        "journal_trends": f"{META} SELECT journal, count(*) AS count FROM papers_meta GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "journal_diversity": f"{META}, j AS (SELECT journal, count(*) AS n FROM papers_meta GROUP BY 1) SELECT count(*) AS total_journals, count(*) FILTER (WHERE n > 1) AS journal_diversity FROM j",
        "term_counts": f"{META}, t AS (SELECT unnest(mesh_terms) AS term FROM papers_meta) SELECT term, count(*) AS count FROM t GROUP BY 1",
        "term_year_counts": f"{META}, t AS (SELECT unnest(mesh_terms) AS term, left(pub_date, 4) AS year FROM papers_meta) SELECT term, year, count(*) AS count FROM t GROUP BY 1, 2",
        "growing_terms": f"""{META}, t AS (SELECT unnest(mesh_terms) AS term, left(pub_date, 4) AS year FROM papers_meta), c AS (SELECT term, year, count(*) AS n FROM t GROUP BY 1, 2),
            l AS (SELECT term, max(year) AS last, count(*) AS years, sum(n)::BIGINT AS total FROM c GROUP BY 1),
            g AS (SELECT l.term, (SELECT n FROM c WHERE c.term = l.term AND c.year = l.last) AS recent, (SELECT avg(n) FROM c WHERE c.term = l.term AND c.year < l.last) AS earlier, total FROM l WHERE years >= 2)
            SELECT term, round((recent - earlier) / greatest(earlier, 1.0), 6) AS growth_rate, recent AS recent_count, total AS total_count FROM g WHERE recent >= 3 ORDER BY (recent - earlier) / greatest(earlier, 1.0) DESC, term LIMIT 10""",
        "author_counts": f"{META}, t AS (SELECT unnest(authors) AS author FROM papers_meta) SELECT author, count(*) AS paper_count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "collab_stats": f"{META}, n AS (SELECT len(authors) AS n FROM papers_meta WHERE len(authors) > 0) SELECT round(avg(n), 6) AS avg_authors_per_paper, max(n)::BIGINT AS max_authors_per_paper, (SELECT count(DISTINCT a) FROM (SELECT unnest(authors) AS a FROM papers_meta)) AS total_unique_authors, count(*) FILTER (WHERE n = 1) AS single_author, count(*) FILTER (WHERE n BETWEEN 2 AND 5) AS small_team, count(*) FILTER (WHERE n > 5) AS large_team FROM n",
        "team_size_distribution": f"{META} SELECT CASE WHEN len(authors) = 1 THEN 'single_author' WHEN len(authors) <= 5 THEN 'small_team' ELSE 'large_team' END AS team, count(*) AS papers FROM papers_meta WHERE len(authors) > 0 GROUP BY 1",
        "topic_period_counts": f"WITH {TOPIC_PAPERS} SELECT topic_id, strftime(date_trunc('quarter', date), '%Y-%m-%d') AS period, count(*) AS count FROM topic_papers GROUP BY 1, 2",
        "topic_trends_month": f"{_BY_MONTH} {_FLAT}",
        "topic_trends_quarter": f"{_trends(TOPIC_PAPERS, 'topic_papers', 'quarter', _QUARTER, '-1')} {_FLAT}",
        "topic_trends_year": f"{_BY_YEAR} {_FLAT}",
        "topic_trends_week": f"{_trends(TOPIC_EVENTS, 'topic_events', 'week', _DAY, chr(39) * 2)} {_FLAT}",
        "topic_trends_day": f"{_trends(TOPIC_EVENTS, 'topic_events', 'day', _DAY, chr(39) * 2)} {_FLAT}",
        "topic_trends_one_period": f"{_trends(TOPIC_EVENTS, 'topic_events', 'month', _MONTH, chr(39) * 2)} {_FLAT}",
        "topic_date_range": f"WITH {TOPIC_PAPERS} SELECT strftime(min(date), '%Y-%m-%d') AS start, strftime(max(date), '%Y-%m-%d') AS \"end\" FROM topic_papers",
        "trending_topics": f"{_BY_MONTH} SELECT topic_id, round(growth_score, 6) AS growth_score FROM trends ORDER BY trends.growth_score DESC, topic_id LIMIT 3",
        "topic_timeline": f"WITH {TOPIC_PAPERS} SELECT topic_id, strftime(date, '%Y-%m') AS time_period, count(*) AS count FROM topic_papers WHERE topic_id = 2 GROUP BY 1, 2",
        "trend_plot_data": f"{_BY_YEAR}, top AS (SELECT topic_id, growth_score FROM trends ORDER BY growth_score DESC, topic_id LIMIT 3) SELECT c.topic_id, strftime(p, '%Y') AS time_period, n AS count, round(growth_score, 6) AS growth_score FROM c JOIN top USING (topic_id)",
        "growth_bars": f"{_BY_YEAR} SELECT topic_id::VARCHAR AS label, round(growth_score, 6) AS growth_score FROM trends ORDER BY trends.growth_score DESC, topic_id LIMIT 3",
        "topic_details": f"{META}, a AS (SELECT CAST(vec_id AS VARCHAR) AS pmid, label AS topic_id, round(({DOT.format(0)} + 1) / 2, 6) AS topic_probability FROM embeddings WHERE label = 3), top AS (SELECT * FROM a ORDER BY topic_probability DESC, pmid LIMIT 10) SELECT pmid, topic_id, topic_probability, pub_date, journal FROM top JOIN papers_meta USING (pmid)",
        "topic_top_terms": f"{META}, t AS (SELECT unnest(mesh_terms) AS term FROM papers_meta JOIN embeddings ON pmid = CAST(vec_id AS VARCHAR) WHERE label = 3) SELECT term, count(*) AS count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "topic_info": "SELECT label AS topic_id, count(*) AS count FROM embeddings GROUP BY 1",
        "ctfidf_keywords": f"{_CTFIDF} SELECT topic_id, rank, word, round(score, 6) AS score FROM best",
        "vocabulary_terms": f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({list(STOP_WORDS)}, w)) AS w FROM documents),
            g AS (SELECT doc_id, unnest(w) AS word FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM t)
            SELECT word, count(*) AS count, count(DISTINCT doc_id) AS df FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2 ORDER BY 2 DESC, 1 LIMIT 200""",
        "date_range_filter": f"{DATED} SELECT pmid, pub_date FROM papers WHERE pub_date BETWEEN '1996-03-01' AND '1997-02-28'",
        "topic_labels": f"{_CTFIDF} SELECT topic_id, string_agg(word, ', ' ORDER BY rank) AS topic_label FROM best WHERE rank <= 3 GROUP BY 1",
        "topic_similarity": "WITH x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), v AS (SELECT label, list(m ORDER BY i) AS v FROM x GROUP BY 1) SELECT a.label AS topic_a, b.label AS topic_b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.label < b.label",
        "extractive_summary": f"""WITH d AS ({DOCS}), l AS (SELECT pmid, abstract, {lead} AS led FROM d), q AS (SELECT *, CASE WHEN len({_words('led')}) > 150 THEN {_first_words('led', 150)} ELSE led END AS picked, length(regexp_replace(abstract, '^\\s+|\\s+$', '', 'g')) < 50 AS short FROM l),
            s AS (SELECT *, CASE WHEN short THEN '' ELSE {summary} END AS summary FROM q)
            SELECT pmid, summary, CASE WHEN short THEN 'Text too short for summarization' ELSE '' END AS error, CASE WHEN short THEN 0 ELSE len({_words('abstract')}) END::BIGINT AS original_length, CASE WHEN short THEN 0 ELSE len({_words('summary')}) END::BIGINT AS summary_length, CASE WHEN short THEN 0.0 ELSE round(len({_words('summary')}) / len({_words('abstract')})::DOUBLE, 6) END AS compression_ratio FROM s""",
        "multi_doc_summary": f"""WITH h AS (SELECT vec_id, {DOT.format(0)} AS score FROM embeddings WHERE vec_id <> 0 ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 5),
            t AS (SELECT string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS source_papers, count(*) AS num_papers, 'Topic: erth. Research findings: ' || string_agg(text, ' ' ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS abstract FROM h JOIN documents ON doc_id = vec_id WHERE text <> ''),
            {_ranked("'erth'", 't')}
            SELECT source_papers, num_papers::BIGINT AS num_papers, len({_words('abstract')})::BIGINT AS original_length, {summary} AS summary FROM q""",
        "post_process": f"SELECT pmid, {_post('abstract')} AS summary FROM {docs}",
        "rouge": f"WITH d AS ({DOCS}), l AS (SELECT pmid, abstract, {lead} AS led FROM d), q AS (SELECT *, CASE WHEN len({_words('led')}) > 150 THEN {_first_words('led', 150)} ELSE led END AS picked FROM l), pairs AS (SELECT pmid, abstract AS reference, CASE WHEN length(regexp_replace(abstract, '^\\s+|\\s+$', '', 'g')) < 50 THEN '' ELSE {summary} END AS candidate FROM q), t AS (SELECT pmid, {_low_words('candidate')} AS a, {_low_words('reference')} AS b FROM pairs), {_rouge(1)}, {_rouge(2)} SELECT pmid, round(r1.f, 6) AS rouge1, round(r2.f, 6) AS rouge2 FROM r1 JOIN r2 USING (pmid)",
        "ranked_hits": f"WITH h AS (SELECT CAST(vec_id AS VARCHAR) AS pmid, {DOT.format(5)} AS s FROM embeddings WHERE vec_id <> 5) SELECT row_number() OVER (ORDER BY s DESC, pmid) AS rank, pmid, printf('%.3f', s) AS score FROM h ORDER BY s DESC, pmid LIMIT 5",
        "jsonl_roundtrip": f"{META} SELECT pmid, pub_date, journal, coalesce(array_to_string(authors, '|'), '') AS authors, coalesce(array_to_string(mesh_terms, '|'), '') AS mesh_terms FROM papers_meta",
        "xml_ingest": f"{META} SELECT pmid, 'Order no. ' || pmid AS title, 'DATE: ' || pub_date || ' Second part.' AS abstract, journal, left(pub_date, 7) AS pub_date, coalesce(array_to_string(list_transform(authors, lambda a: 'S ' || a), '|'), '') AS authors, coalesce(array_to_string(mesh_terms, '|'), '') AS mesh_terms FROM papers_meta",
        "query_summary": f"""WITH d AS ({DOCS}), {_ranked("'the', 'and', 'attion', 'thanedble'", 'd', 'pmid')}
            SELECT pmid, CASE WHEN length(regexp_replace(abstract, '^\\s+|\\s+$', '', 'g')) < 50 THEN '' ELSE {summary} END AS summary FROM q""",
        "union_all_domains": f"SELECT journal, count(*) AS papers FROM ({_DOMAINS}) GROUP BY 1",
        "union_distinct_domains": f"SELECT journal, count(DISTINCT doc_id) AS papers FROM ({_DOMAINS}) GROUP BY 1",
        "dedup_by_text": "SELECT CAST(min(doc_id) AS VARCHAR) AS pmid FROM documents GROUP BY text",
        "paper_lookup": f"{META} SELECT pmid, pub_date, journal, coalesce(array_to_string(authors, '|'), '') AS authors, coalesce(array_to_string(mesh_terms, '|'), '') AS mesh_terms FROM papers_meta WHERE pmid = '7'",
        "embedding_stats": "SELECT count(*) AS num_embeddings, max(len(embedding))::BIGINT AS embedding_dim, 'hashed tf-idf' AS model_name, 'flat inner product' AS index_type, count(DISTINCT vec_id) AS num_papers FROM embeddings",
        "system_stats": f"{META}, j AS (SELECT journal, count(*) AS n FROM papers_meta GROUP BY 1) SELECT (SELECT count(*) FROM papers_meta) AS total_papers, (SELECT count(*) FROM j) AS total_journals, (SELECT count(*) FILTER (WHERE n > 1) FROM j) AS journal_diversity, (SELECT count(*) FROM embeddings) AS num_embeddings, (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS embedding_dim",
        "card_display": f"SELECT pmid, left(journal, 30) || '...' AS journal, CASE WHEN length(abstract) > 500 THEN left(abstract, 500) || '...' ELSE abstract END AS abstract FROM {docs}",
        "event_windows": "SELECT event_type AS topic_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, count(*) AS count FROM events GROUP BY 1, 2",
    }
