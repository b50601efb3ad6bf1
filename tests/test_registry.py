"""The SQL functions give what the column functions give."""

from pyspark.sql import functions as F

from quire.functions import registry
from quire.functions import text as T
from quire.functions.rouge import rouge_n

TEXTS = ["Gene  editing [1, 2-3] works (12). It also repairs the damaged tissue. Done.", "café &amp;lt; \"q\"", "", None, "a b a", "See doi:10.1/x now © 2020 'n"]


def test_registered(spark):
    registry.register(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, x string")
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT clean_text(x) a, word_count(x) b, split_sentences(x) c, round(rouge_1(x, 'a b b the tissue'), 9) d FROM texts ORDER BY i").collect()
    x = F.col("x")
    want = df.orderBy("i").select(T.clean_text(x), T.word_count(x), T.split_sentences(x), F.round(rouge_n(x, F.lit("a b b the tissue")), 9)).collect()
    assert list(map(tuple, got)) == list(map(tuple, want))
    long = " ".join(f"Sentence number {i} has a few words in it [3]." for i in range(12))
    chunks = spark.createDataFrame([(long,), ("",), (None,)], "x string").select("x", T.chunk_sentences(T.split_sentences(x), 25).alias("c"))
    chunks.createOrReplaceTempView("chunked")
    assert spark.sql("SELECT chunk_text(x, 25) a, c FROM chunked").filter("not (a <=> c)").count() == 0 and chunks.first()["c"][1].startswith("Sentence number 1 ")
    for n in (1, 2, 3):
        got = df.select(F.expr(f"rouge_n(x, 'a b a works it also', {n})").alias("a"), rouge_n(x, F.lit("a b a works it also"), n).alias("b")).collect()
        assert all(abs(r["a"] - r["b"]) < 1e-12 for r in got) and any(r["a"] > 0 for r in got)
    assert spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) d").first()["d"] == 11.0
    assert spark.sql("SELECT nfkd('é') n, lcs_length(array('a', 'b'), array('b')) l").first().asDict() == {"n": "é", "l": 1}
