"""Golden rows of cleaning, sentences, chunks, summaries and ROUGE."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.config import EngineConfig
from quire.functions import rouge
from quire.functions import text as T
from quire.operators import prepare, summaries


def each(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


CLEAN = [
    ("Gene  editing works [1, 2-3] in vivo (12).", "Gene editing works in vivo ."),
    ("Range [1–3] stays (a1).", "Range [1–3] stays (a1)."),
    ("Text © 2020 Smith 2021 end", "Text Smith 2021 end"),
    ("Text © Smith 20201 end", "Text 1 end"),
    ("See doi:10.1/x now", "See now"),
    ("See doi: 10.1/x now", "See 10.1/x now"),
    ("See doi:10.1/x", "See doi:10.1/x"),
    ("A &amp;lt; B &quot;q&quot;", 'A < B "q"'),
    ("café ﬁt", "café fit"),
    ("[12] (2019)", ""),
    ("", ""),
    (None, ""),
    ("  ", ""),
]


def test_clean(spark):
    assert each(spark, [a for a, _ in CLEAN], T.clean_text) == [b for _, b in CLEAN]


def python_clean(x):
    x = re.sub(r"\s+", " ", unicodedata.normalize("NFKD", x))
    for pattern in (r"\[[\d\s,-]+\]", r"\([\d\s,-]+\)", "©.*?\\d{4}", r"doi:.*?\s"):
        x = re.sub(pattern, "", x)
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        x = x.replace(a, b)
    return " ".join(x.split())


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="ab [](),-12© doi:&amp;ltéﬁ \n.", max_size=40), min_size=50, max_size=100))
def test_clean_is_the_rules(spark, values):
    assert each(spark, values, T.clean_text) == list(map(python_clean, values))


def test_word_count(spark):
    assert each(spark, ["", None, " a b ", "one"], T.word_count) == [0, 0, 2, 1]


def test_sentences(spark):
    text = "This is the first sentence here. Short one. And (this) is the third sentence! 2 numbers start the fourth one? lower case goes on."
    assert each(spark, [text, "", None], T.split_sentences) == [["This is the first sentence here.", "And (this) is the third sentence!", "2 numbers start the fourth one? lower case goes on."], [], []]


def test_chunks(spark):
    got = each(spark, [["a b", "c d e", "f", "g h"], [], ["x"], ["a b c d e f", "g"]], lambda x: T.chunk_sentences(x, 4), "array<string>")
    assert got == [["a b", "a b c d e", "c d e f", "f g h"], [], ["x"], ["a b c d e f", "a b c d e f g"]]


def python_chunks(sentences, most):
    done, now, n = [], [], 0
    for s in sentences:
        k = len(s.split())
        if now and n + k > most:
            done.append(" ".join(now))
            now, n = now[-1:], len(now[-1].split())
        now.append(s)
        n += k
    return done + ([" ".join(now)] if now else [])


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b c", "d e f", "g h i j k l"]), max_size=9), min_size=20, max_size=30))
def test_chunks_are_the_fold(spark, values):
    assert each(spark, values, lambda x: T.chunk_sentences(x, 5), "array<string>") == [python_chunks(v, 5) for v in values]


def test_post_process(spark):
    assert each(spark, ["One. Two. Thr", "One", "A ..", "A... B."], T.post_process) == ["One. Two.", "One.", "A.", "A.. B."]


def test_validate_and_process(spark):
    body = "word " * 20
    rows = [("1", "T", body), ("2", None, None), (None, "T", body), ("4", "", "x" * 49), ("5", "", "x" * 50), ("6", "", "x" * 10_000), ("7", "", "x" * 10_001), ("", "T", body)]
    papers = spark.createDataFrame([(*r, None, None, None, None, "kept?") for r in rows], "pmid string, title string, abstract string, authors array<string>, journal string, pub_date string, mesh_terms array<string>, sentences string")
    done, counts = prepare.process_valid(papers)
    got = {r["pmid"]: r for r in done.collect()}
    assert set(got) == {"1", "5", "6"}
    assert counts.get == {"seen": 8, "processed": 3}
    assert got["1"]["text_content"] == "T. " + body.strip() and got["1"]["word_count"] == 21 and got["1"]["authors"] == [] and got["1"]["pub_date"] == "Unknown"
    assert got["5"]["text_content"] == ". " + "x" * 50
    assert prepare.process(papers.limit(0)).count() == 0


def test_summaries(spark):
    long = " ".join(f"Sentence number {i} has some words in it." for i in range(12))
    papers = spark.createDataFrame([("1", long, "old"), ("2", "short", "old"), ("3", None, "old"), ("4", "", "old")], "pmid string, text_content string, summary string")
    got = {r["pmid"]: r for r in summaries.summarize_papers(papers).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"]["summary"].count("Sentence") == 6 and got["1"]["summary"].endswith("it.")
    assert got["2"]["summary"] == "" and got["2"]["error"] == summaries.TOO_SHORT
    asked = summaries.summarize_papers(papers, query="number 11", config=EngineConfig(summary_sentences=2)).filter("pmid = 1").first()["summary"]
    assert "number 11" in asked
    empty = summaries.multi_paper_summary(papers.limit(0), [F.col("pmid")]).first()
    assert empty["error"] == "No papers provided" and empty["num_papers"] == 0
    none = summaries.multi_paper_summary(papers.filter("pmid = 3").drop("summary"), [F.col("pmid")]).first()
    assert none["error"] == "No text content found" and none["source_papers"] == ["3"]


def test_rouge(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sat on the mat"), ("a a b", "a b b"), ("", "x"), (None, None)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = [tuple(round(x, 6) for x in r) for r in df.select(rouge.rouge_n(a, b), rouge.rouge_n(a, b, 2), rouge.rouge_l(a, b)).collect()]
    assert got == [(round(6 / 9, 6), round(4 / 7, 6), round(6 / 9, 6)), (round(4 / 6, 6), 0.5, round(4 / 6, 6)), (0, 0, 0), (0, 0, 0)]


@pytest.mark.parametrize(("env", "domains"), [({}, ("biomedical research",)), ({"RESEARCH_DOMAINS": " a, ,b "}, ("a", "b"))])
def test_config(env, domains):
    assert EngineConfig.from_env(env).domains == domains


STEMS = (
    "caresses:caress ponies:poni ties:tie caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss "
    "fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit conformabli:conform radicalli:radic differentli:differ vileli:vile "
    "analogousli:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl "
    "triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust "
    "defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler "
    "probate:probat rate:rate cease:ceas controll:control roll:roll dying:die news:news died:die enjoy:enjoy by:by"
)


def test_stems():
    from quire.functions.stem import stem

    assert {w: stem(w) for w, _ in (x.split(":") for x in STEMS.split())} == dict(x.split(":") for x in STEMS.split())


def test_rouge_of_stems(spark):
    from quire.functions.rouge import rouge_l, rouge_n

    row = spark.createDataFrame([("Cats were running, hopefully", "a cat runs in hope")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = row.select(rouge_n(a, b), rouge_n(a, b, stemmed=True), rouge_n(a, b, 2, stemmed=True), rouge_l(a, b, stemmed=True)).first()
    # cat were run hope; a cat run in hope
    assert [round(x, 6) for x in got] == [0.0, 0.666667, 0.0, 0.666667]
