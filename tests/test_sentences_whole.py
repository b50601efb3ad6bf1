"""All that is learnt is kept, also more than a task holds in memory."""

from collections import Counter

from pyspark.sql import functions as F

from quire.functions import sentences as sn


def test_nothing_learnt_is_dropped(spark, monkeypatch):
    words = [f"{a}{b}" for a in "bcdfghk" for b in "lmnrstv"]
    one = lambda i: f"The {words[i]}. Novak{words[i]} saw them in {words[-i]}. {i} of it\x1f. However we left\x1f it. Number {i}. Of all."
    texts = [" ".join(one(i) for _ in range(9)) for i in range(len(words))]
    rows = spark.createDataFrame([(t,) for t in texts], "text_content string").repartition(3)
    whole = sn.train(rows)
    kinds = ("abbreviations", "collocations", "starters")
    assert all(isinstance(getattr(whole, k), frozenset) and len(getattr(whole, k)) > 1 for k in kinds)
    monkeypatch.setattr(sn, "MOST", 1)
    filed = sn.train(rows)
    for k in kinds:
        assert isinstance(getattr(filed, k), sn.Filed) and all(x in getattr(filed, k) for x in getattr(whole, k))
    seen = Counter(w.lower() for t in texts for w in t.replace(".", " ").split())
    for w in seen:
        assert (w in filed.abbreviations) == (w in whole.abbreviations) and (w in filed.starters) == (w in whole.starters)
        assert all(((w, x) in filed.collocations) == ((w, x) in whole.collocations) for x in list(seen)[:20])
    split = lambda by: rows.select(sn.split_trained(F.col("text_content"), by).alias("s")).collect()
    assert split(filed) == split(whole) != split(sn.Splitter())
