"""The vocabulary counts a text's words before it shuffles them; rows of one id are still one document."""

from collections import Counter

from quire.operators import topics

ROWS = [("a", "cell cell gene"), ("b", "gene tumour"), ("b", "gene cell"), ("c", None), (None, "gene virus"), (None, "virus"), ("d", "virus cell"), ("e", "")]


def test_vocabulary_with_repeated_ids(spark):
    for rows in (ROWS, [r for r in ROWS if r[0] in ("a", "c", "d", "e")]):
        held, count = {}, Counter()
        for i, t in rows:
            for w in (t or "").split():
                count[w] += 1
                held.setdefault(w, set()).add(i)
        for least in (1, 2):
            want = sorted(((w, n, len(held[w])) for w, n in count.items() if len(held[w]) >= least), key=lambda x: (-x[1], x[0]))
            got = topics.vocabulary(spark.createDataFrame(rows, "pmid string, text_content string"), 1, least)
            assert [tuple(r) for r in got.collect()] == want
    unique = spark.createDataFrame([r for r in ROWS if r[0] == "a"], "pmid string, text_content string")
    assert "pmid" not in "".join(x for x in topics.vocabulary(unique, 1, 1)._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate" in x)
