"""What k-means keeps while it runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.clustering import KMeans

from plaudit.operators import themes as th
from plaudit.sources.readers import small_table


def kept(spark):
    return [(x.memSize(), x.diskSize()) for x in spark.sparkContext._jsc.sc().getRDDStorageInfo() if x.isCached()]


def test_texts_are_not_kept_beside_the_vectors(spark, monkeypatch):
    """Cleaned texts are never in memory, and gone when k-means starts; reviews without words are members too."""
    texts = ["battery life short"] * 5 + ["screen flickers dim"] * 4 + ["delivery box late"] * 3 + ["", "the of", None]
    before, seen, words = len(kept(spark)), [], []
    fit, vocabulary = KMeans.fit, th.tfidf.fit_vocabulary
    monkeypatch.setattr(KMeans, "fit", lambda self, data: seen.append(len(kept(spark))) or fit(self, data))

    def counted(*args, **named):
        out = vocabulary(*args, **named)
        words.extend(kept(spark))
        return out

    monkeypatch.setattr(th.tfidf, "fit_vocabulary", counted)
    reviews = small_table(spark, {"review_id": range(len(texts)), "review_text": texts}, "review_id bigint, review_text string")
    rows = th.find_themes(reviews, replace(th.ThemeConfig(), clusters=3)).collect()
    assert sum(r["size"] for r in rows) == len(texts)
    assert len(words) == before + 1 and any(memory == 0 and disk > 0 for memory, disk in words)
    assert seen == [before + 1]
    assert len(kept(spark)) == before
