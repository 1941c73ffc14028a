"""Features, classifiers, soft vote, cross-validation, saving and loading.

The members are a logistic regression, a random forest and boosted trees. The final model and
those of all folds are fitted together: rows are numbered and stored once, and every pass serves
all of them (``logistic``, ``trees``). Fitting takes all labelled rows; scoring is map-only.
"""

from __future__ import annotations

import io
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaudit.functions.signals import with_signals
from plaudit.functions.text import clean_tokens, english_stop_words, vectorizer_tokens
from plaudit.operators import metrics as met
from plaudit.operators import tfidf
from plaudit.operators.binned import column_store, number_rows
from plaudit.operators.logistic import Linear, fit_logistic, row_store
from plaudit.operators.scoring import prediction_columns
from plaudit.operators.trees import Boosted, Forest, Trees, fit_boosted, fit_forests
from plaudit.rules import FOLDS, SEED, SIGNAL_COLUMNS, TEST_PERCENT
from plaudit.sources.readers import SourceError, small_table
from plaudit.sources.writers import point_to


@dataclass(frozen=True)
class TrainConfig:
    """Settings of features and members; the defaults are the full-size job."""

    max_features: int = 8000
    max_n: int = 2
    sublinear: bool = True
    signals: bool = True
    scale_signals: bool = False
    cleaned: bool = True
    members: tuple[str, ...] = ("lr", "rf", "gbt")
    lr_iterations: int = 1000
    lr_c: float = 1.0
    trees: int = 150
    tree_depth: int = 12
    rounds: int = 150
    round_depth: int = 6
    step: float = 0.1
    seed: int = SEED
    folds: int = FOLDS
    test_percent: int = TEST_PERCENT
    stratified: bool = True
    oversample: bool = True
    neighbours: int = 5
    fit_scope: str = "train"
    stop_words: tuple[str, ...] | None = None  # None: the English list
    lemmas: tuple[tuple[str, str], ...] = ()  # (form, lemma), before the noun endings; see lemma_pairs


# The earlier, smaller job: raw words, no signals, logistic regression only.
LEGACY_CONFIG = TrainConfig(
    max_features=5000, max_n=1, sublinear=False, signals=False, cleaned=False, members=("lr",),
    stratified=False, oversample=False, folds=0,
)


@dataclass(frozen=True)
class FeatureModel:
    """Vocabulary and signal settings that turn reviews into feature vectors."""

    config: TrainConfig
    vocabulary: tfidf.Vocabulary
    scaler: StandardScalerModel | None = field(default=None, compare=False)

    def _tokens(self, reviews: DataFrame) -> Column:
        return words_of(reviews, self.config)

    def transform(self, reviews: DataFrame) -> DataFrame:
        """Add ``features`` (and the signal columns). Map-only."""
        signals = with_signals(reviews) if self.config.signals else reviews
        if not self.config.signals:
            return tfidf.tfidf_vectors(signals, self._tokens(reviews), self.config.max_n, self.vocabulary, "features").drop(WORDS)
        vectors = tfidf.tfidf_vectors(signals, self._tokens(reviews), self.config.max_n, self.vocabulary, "_tfidf").drop(WORDS)
        part = "_signals" if self.scaler else None
        if part:
            raw = VectorAssembler(inputCols=list(SIGNAL_COLUMNS), outputCol="_raw")
            vectors = self.scaler.transform(raw.transform(vectors)).drop("_raw")
        inputs = ["_tfidf", *([part] if part else SIGNAL_COLUMNS)]
        out = VectorAssembler(inputCols=inputs, outputCol="features").transform(vectors)
        return out.drop("_tfidf", *([part] if part else []))


WORDS = "_cleaned_words"  # a column of ``feature_tokens`` taken before


def words_of(reviews: DataFrame, config: TrainConfig) -> Column:
    """The words of ``reviews``: those in the column ``WORDS`` if it is there."""
    return F.col(WORDS) if WORDS in reviews.columns else feature_tokens(config)


def feature_tokens(config: TrainConfig) -> Column:
    text = F.col("review_text")
    if config.cleaned:
        stop = english_stop_words() if config.stop_words is None else config.stop_words
        return F.filter(clean_tokens(text, stop, lemmas=config.lemmas), lambda w: F.length(w) > 1)
    return vectorizer_tokens(text, config.stop_words or ())


def fit_features(reviews: DataFrame, config: TrainConfig) -> FeatureModel:
    vocabulary = tfidf.fit_vocabulary(
        reviews, words_of(reviews, config), config.max_n, config.max_features, config.sublinear
    )
    scaler = None
    if config.signals and config.scale_signals:
        raw = VectorAssembler(inputCols=list(SIGNAL_COLUMNS), outputCol="_raw").transform(with_signals(reviews))
        scaler = StandardScaler(inputCol="_raw", outputCol="_signals", withMean=False, withStd=True).fit(raw)
    return FeatureModel(config, vocabulary, scaler)


SCORED_ROWS = 256  # rows made dense at once


def _cells(parts: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the non-zero cells of a column of vectors."""
    values, indices = parts.field("values"), parts.field("indices")
    size = np.diff(values.offsets.to_numpy()).astype(np.int64)
    vals = values.flatten().to_numpy()
    rows = np.repeat(np.arange(len(parts)), size)
    cols = np.arange(len(vals)) - np.repeat(np.cumsum(size) - size, size)
    sparse = np.repeat(indices.is_valid().to_numpy(zero_copy_only=False), size)
    cols[sparse] = indices.flatten().to_numpy()
    held = vals != 0
    return rows[held], cols[held], vals[held]


@dataclass(frozen=True)
class VoteModel:
    """Mean of the members' probabilities, equal weights; a tie is class 0."""

    members: dict[str, Linear | Forest | Boosted]

    def shares(self, parts: pa.StructArray) -> np.ndarray:
        """Mean probability of class 1 for every vector."""
        rows, cols, vals = _cells(parts)
        total = np.zeros(len(parts))
        trees = [m for m in self.members.values() if not isinstance(m, Linear)]
        for member in self.members.values():
            if isinstance(member, Linear):
                total += member.probabilities(rows, cols, vals, len(parts))
        if trees:
            used = np.unique(np.concatenate([m.trees.column[m.trees.column >= 0] for m in trees] + [np.zeros(1, dtype=np.int64)]))
            place = np.minimum(np.searchsorted(used, cols), len(used) - 1)
            held = used[place] == cols
            rows, place, vals = rows[held], place[held], vals[held]
            for first in range(0, len(parts), SCORED_ROWS):
                last = min(first + SCORED_ROWS, len(parts))
                a, b = np.searchsorted(rows, [first, last])
                dense = np.zeros((last - first, len(used)))
                dense[rows[a:b] - first, place[a:b]] = vals[a:b]
                for member in trees:
                    total[first:last] += member.probabilities(dense, used)
        return total / len(self.members)

    def transform(self, features: DataFrame) -> DataFrame:
        """Add ``genuine`` (probability) and ``predicted`` (0 or 1). Map-only, in Arrow batches."""
        shared = features.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def genuine(parts: pa.Array) -> pa.Array:
            return pa.array(shared.value.shares(parts))

        out = features.withColumn("genuine", genuine(F.unwrap_udt("features")))
        return out.withColumn("predicted", (F.col("genuine") > 0.5).cast("int"))

    def to_arrays(self) -> dict[str, bytes]:
        """Every member as bytes of its arrays."""
        found = {}
        for name, member in self.members.items():
            if isinstance(member, Linear):
                arrays = {"weights": member.weights, "intercept": np.array(member.intercept)}
            else:
                arrays = {f: getattr(member.trees, f) for f in Trees.__dataclass_fields__}
                if isinstance(member, Boosted):
                    arrays["losses"] = np.array(member.losses)
            file = io.BytesIO()
            np.savez_compressed(file, **arrays)
            found[name] = file.getvalue()
        return found

    @classmethod
    def from_arrays(cls, stored: dict[str, bytes]) -> VoteModel:
        members = {}
        for name, data in stored.items():
            arrays = dict(np.load(io.BytesIO(data)))
            if "weights" in arrays:
                members[name] = Linear(arrays["weights"], float(arrays["intercept"]))
                continue
            trees = Trees(**{f: arrays[f] for f in Trees.__dataclass_fields__})
            members[name] = Boosted(trees, tuple(arrays["losses"].tolist())) if "losses" in arrays else Forest(trees)
        return cls(members)


def fit_votes(training: DataFrame, config: TrainConfig, left_out: list[int | None]) -> list[VoteModel]:
    """One vote for each entry of ``left_out``: the fold whose rows it does not see, or None for all rows.

    ``training`` has row_key, label and features, and fold if any is left out. All of its rows are
    fitted, all models together, so that each pass over the rows serves all of them.
    """
    rows = number_rows(training, config.seed)
    members = np.stack([np.ones(rows.count, dtype=bool) if f is None else rows.folds != f for f in left_out])
    boosting, forests = "gbt" in config.members, "rf" in config.members
    found: dict[str, list] = {}

    def linear() -> None:
        store = row_store(rows)
        found["lr"] = fit_logistic(store, rows, members, config.lr_c, config.lr_iterations)
        store.free()

    def forest(store) -> None:
        names = [0 if f is None else f + 1 for f in left_out]
        found["rf"] = fit_forests(store, rows, members, config.trees, config.tree_depth, config.seed, names)

    def boosted(store) -> None:
        found["gbt"] = fit_boosted(store, rows, members, config.rounds, config.round_depth, config.step)

    # The members do not depend on each other: passes of one fill the cores that another leaves idle.
    with ThreadPoolExecutor(3) as pool:
        begun = [pool.submit(inheritable_thread_target(training.sparkSession)(linear))] if "lr" in config.members else []
        if boosting or forests:
            store = column_store(rows)
            wanted = [boosted] * boosting + [forest] * forests
            begun += [pool.submit(inheritable_thread_target(training.sparkSession)(fit), store) for fit in wanted]
        for fit in begun:
            fit.result()
    if boosting or forests:
        store.free()
    unknown = set(config.members) - set(found)
    if unknown:
        raise ValueError(f"unknown member {sorted(unknown)[0]}")
    return [VoteModel({name: found[name][i] for name in config.members}) for i in range(len(left_out))]


def fit_vote(training: DataFrame, config: TrainConfig) -> VoteModel:
    """Fit all members on (row_key, label, features)."""
    return fit_votes(training, config, [None])[0]


def fold_scores(training: DataFrame, models: list[VoteModel]) -> DataFrame:
    """(fold, score): F1 of class 1 of each fold by the model that did not see it; one map pass."""
    shared = training.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf("double")
    def genuine(parts: pa.Array, folds: pa.Array) -> pa.Array:
        own, out = folds.to_numpy(zero_copy_only=False), np.zeros(len(parts))
        for fold in np.unique(own).tolist():
            at = np.flatnonzero(own == fold)
            out[at] = shared.value[fold].shares(parts.take(pa.array(at)))
        return pa.array(out)

    held = training.select("fold", "label", genuine(F.unwrap_udt("features"), F.col("fold")).alias("genuine"))
    return met.fold_metrics(held.select("fold", "label", (F.col("genuine") > 0.5).cast("int").alias("prediction")))


def cross_validate(training: DataFrame, config: TrainConfig) -> DataFrame:
    """(fold, score): F1 of class 1 per fold. ``training`` has row_key, label, features, fold."""
    return fold_scores(training, fit_votes(training, config, list(range(config.folds))))


@dataclass(frozen=True)
class AuthenticityModel:
    """Feature model and vote: scores review tables."""

    features: FeatureModel
    vote: VoteModel

    def score(self, reviews: DataFrame) -> DataFrame:
        """Add prediction, probabilities and the signals as a struct. Map-only."""
        signals = self.features.config.signals
        out = self.vote.transform(self.features.transform(reviews)).drop("features")
        scored = prediction_columns(out, F.col("predicted"), F.col("genuine")).drop("genuine", "predicted")
        if not signals:
            scored = with_signals(scored)
        return scored.withColumn("behavioral_signals", F.struct(*SIGNAL_COLUMNS)).drop(*SIGNAL_COLUMNS)

    def save(self, spark: SparkSession, path: str) -> str:
        """Write a new version below ``path`` and then point to it; returns the version's name.

        The pointer is replaced by one rename, so readers see the old version or the new one,
        and a save that dies halfway leaves the old one in place.
        """
        version = f"v-{uuid.uuid4().hex}"
        if self.features.scaler:
            self.features.scaler.write().save(f"{path}/{version}/scaler")
        values = {"config": json.dumps(asdict(self.features.config)), "vocabulary": self.features.vocabulary.to_json()}
        rows = [(name, text.encode()) for name, text in values.items()] + [(f"member {n}", v) for n, v in self.vote.to_arrays().items()]
        table = small_table(spark, dict(zip(("name", "value"), map(list, zip(*rows)))), "name string, value binary")
        table.coalesce(1).write.parquet(f"{path}/{version}/model")
        point_to(spark, path, version)
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> AuthenticityModel:
        """The version that ``path`` points to, or the one named."""
        try:
            version = version or spark.read.text(f"{path}/CURRENT").first()["value"]
            rows = {r["name"]: bytes(r["value"]) for r in spark.read.parquet(f"{path}/{version}/model").collect()}
            read = json.loads(rows["config"])
            read.pop("fit_rows", None)  # of versions saved when fits took a part of the rows
            lists = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) for k, v in read.items() if isinstance(v, list)}
            config = TrainConfig(**read | lists)
            vote = VoteModel.from_arrays({name: rows[f"member {name}"] for name in config.members})
            scaler = StandardScalerModel.load(f"{path}/{version}/scaler") if config.signals and config.scale_signals else None
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise SourceError("MODEL_NOT_FOUND", f"no trained model at {path}; train and save one first") from error
        return cls(FeatureModel(config, tfidf.Vocabulary.from_json(rows["vocabulary"].decode()), scaler), vote)


def score_text(model: AuthenticityModel, spark: SparkSession, text: str | None) -> DataFrame:
    """One review as a one-row table; blank text is refused."""
    if text is None or not text.strip():
        raise SourceError("EMPTY_TEXT", "the review text cannot be empty")
    one = small_table(spark, {"review_id": [0], "review_text": [text.strip()]}, "review_id bigint, review_text string")
    return model.score(one)
