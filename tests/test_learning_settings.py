"""The registered learning queries run with the operators' own settings."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from plaudit.catalog import learning
from plaudit.operators import themes as th
from plaudit.operators.model import LEGACY_CONFIG, TrainConfig

SF = "/root/testdata/sf0.001"


def test_fits_take_the_default_settings(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(learning, "_fitted", {})
    monkeypatch.setattr(learning, "fit_vote", lambda rows, config: seen.append(config) or SimpleNamespace(transform=lambda r: r.withColumns({"predicted": F.lit(1), "genuine": F.lit(1.0)})))
    monkeypatch.setattr(learning, "cross_validate", lambda rows, config: seen.append(config) or rows.select("fold").distinct())
    monkeypatch.setattr(learning, "train", lambda data, config, name: seen.append(config) or SimpleNamespace(run=None, report=None))
    found = learning.queries()
    assert found["q_cross_validate"](spark, SF).count() == TrainConfig().folds
    for name in ("q_vote", "q_logistic", "q_forest", "q_boosted", "q_train_evaluate", "q_train_legacy"):
        found[name](spark, SF)
    alone = [TrainConfig(members=(m,)) for m in ("lr", "rf", "gbt")]
    assert seen == [TrainConfig(), TrainConfig(), *alone, TrainConfig(), LEGACY_CONFIG]


def test_themes_take_the_default_settings(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(learning.th, "find_themes", lambda rows, config: seen.append(config))
    monkeypatch.setattr(learning.th, "topic_lines", lambda rows, config: seen.append(config))
    learning.q_kmeans_themes(spark, SF)
    learning.q_topics_legacy(spark, SF)
    assert seen == [th.ThemeConfig(), th.LEGACY_THEMES] and learning.THEMES == th.ThemeConfig()


def test_features_have_all_terms(spark):
    terms = learning.q_features(spark, SF).filter("value <> 0").agg(F.max("idx")).first()[0]
    assert terms > 1000
