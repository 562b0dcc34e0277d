"""Quality classifier: learned vectors of hashed words, word pairs and character n-grams, averaged per document; softmax on top."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotledger.llm.common import SPACE, give_back, tidy

#: Buckets of each kind of feature (a power of two), its n-grams' lengths in code points with the word's ends, and length of a vector.
BITS, GRAMS, SIZE = 15, (2, 3, 4), 16
#: The bound of the sample that is learnt from, in rows, half of them of each label.
MAX_SAMPLE = 2000
STEPS, RATE, SPREAD, SEED = 16_000, 2.0, 0.1, 42
#: Features of no weight that each kind's average counts beside a text's own, so that a few words alone decide little.
PRIOR = (10, 10, 60)
#: Words that are looked at together: the whole text is read, so many at a time.
PIECE = 20_000
#: Label 1 is predicted from this score on.
LEAST = 0.3
KINDS = 3
_BREAK = re.compile(SPACE)
_ROLL, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64) + (kind << BITS)


def pieces(text: str | None) -> Iterator[list[np.ndarray]]:
    """Of every PIECE words of a text the buckets of its words, of its pairs of neighbours, and of its words' n-grams.

    A pair's hash is the exclusive or of its words', so that a word beside itself is one and the same feature whatever the word.
    """
    words, last = [w for w in _BREAK.split(text or "") if w], None
    for at in range(0, len(words), PIECE):
        codes = np.frombuffer(f" {' '.join(words[at : at + PIECE])} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        gaps = np.flatnonzero(codes == 32)
        starts, sizes = gaps[:-1] + 1, np.diff(gaps) - 1
        powers = np.multiply.accumulate(np.full(int(sizes.max()) + 1, _ROLL))
        place = np.arange(len(codes)) - np.repeat(gaps, np.append(sizes + 1, 1)) - 1
        hashes = np.add.reduceat((codes + np.uint64(1)) * powers[np.maximum(place, 0)] * (place >= 0), starts)
        line = hashes if last is None else np.append(last, hashes)
        last = hashes[-1:]
        found, rolled = [], codes + np.uint64(1)
        inner = np.cumsum(codes == 32)
        for n in range(2, max(GRAMS) + 1):
            rolled = rolled[:-1] * _ROLL + codes[n - 1 :] + np.uint64(1)
            if n in GRAMS and len(rolled):
                # No blank but at the ends, and not two words' ends alone.
                whole = (inner[n - 2 : len(codes) - 1] - inner[: len(rolled)] == 0) & ((n > 2) | (codes[: len(rolled)] != 32) | (codes[n - 1 :] != 32))
                found.append(rolled[whole])
        yield [_bucket(hashes, 0), _bucket(line[1:] ^ line[:-1], 1), _bucket(np.concatenate(found), 2)]


def weights(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features and what share each has in the text's average: the kinds weigh the same. Both empty without words."""
    counts = np.zeros(KINDS << BITS)
    for piece in pieces(text):
        for ids in piece:
            counts += np.bincount(ids, minlength=len(counts))
    by_kind = counts.reshape(KINDS, -1)
    shares = (by_kind / (by_kind.sum(axis=1) + PRIOR)[:, None] / KINDS).ravel()
    at = np.flatnonzero(shares)
    return at.astype(np.int32), shares[at].astype(np.float32)


@dataclass(frozen=True)
class Model:
    """vectors: one for each bucket; heads: from the mean vector to the two labels' scores, with their constant."""

    vectors: np.ndarray
    heads: np.ndarray
    bias: np.ndarray

    @cached_property
    def leaning(self) -> np.ndarray:
        """What each feature adds to the difference of the two labels' scores: an average and what follows it are linear, so that documents need one number for each."""
        return self.vectors.astype(np.float64) @ (self.heads[:, 1] - self.heads[:, 0])

    def score(self, text: str | None) -> float:
        sums, sizes = np.zeros(KINDS), np.zeros(KINDS)
        for piece in pieces(text):
            for kind, ids in enumerate(piece):
                sums[kind] += self.leaning[ids].sum()
                sizes[kind] += len(ids)
        return float(1 / (1 + np.exp(-np.clip((sums / (sizes + PRIOR)).sum() / KINDS + self.bias[1] - self.bias[0], -500, 500))))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS, rate: float = RATE, size: int = SIZE, seed: int = SEED) -> Model:
    """A model by stochastic gradient descent, a document a step, so many of them, the rate falling to nothing. examples: weights() and label, in an order that doesn't hang on chance."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-SPREAD, SPREAD, (KINDS << BITS, size)).astype(np.float32)
    heads, bias = rng.uniform(-1, 1, (size, 2)) * SPREAD, np.zeros(2)
    done = 0
    # An average of many features moves each of them by little: steps in the vectors are larger by a constant for that.
    while done < steps:
        for i in rng.permutation(len(examples))[: steps - done]:
            ids, shares, label = examples[i]
            now = rate * (1 - done / steps)
            mean = shares @ vectors[ids] if len(ids) else np.zeros(size)
            off = softmax(mean @ heads + bias)
            off[label] -= 1
            back = heads @ off
            heads -= 0.1 * now * np.outer(mean, off)
            bias -= 0.01 * now * off
            if len(ids):
                vectors[ids] -= (now * np.minimum(1, 100 * shares)[:, None] * back).astype(np.float32)
            done += 1
    return Model(vectors, heads, bias)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_sample: int = MAX_SAMPLE) -> Model | None:
    """A model of the labelled documents that aren't held out: of each label those least by a digest of the key, max_sample rows at most in all.

    Labels other than 0 and 1, and null ones, are not learnt from; a key that is labelled twice alike counts once. Only
    keys meet the labels; the features of the sample's texts are made where the texts are. None if there is no such row.
    """
    each = max(1, max_sample // 2)
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(key) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).distinct()
    usable = usable.join(docs.select(F.col(key).alias("_key")), "_key", "left_semi").withColumn("_mark", F.xxhash64(F.col("_key").cast("string")))
    chosen = [usable.filter(F.col("_label") == x).orderBy("_mark", "_key").limit(each) for x in (0, 1)]
    chosen = chosen[0].union(chosen[1])

    @F.pandas_udf("ids array<int>, shares array<float>")
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([weights(t) for t in texts], columns=["ids", "shares"])

    near = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").distinct()
    made = near.select("_label", "_mark", features("_text").alias("f"), F.xxhash64("_text").alias("_tie")).select("_label", "_mark", "_tie", "f.*").toPandas()
    if not len(made):
        return None
    made = made.sort_values(["_mark", "_tie", "_label"], kind="stable").groupby("_label").head(each)
    model = fit([(np.asarray(i, np.int64), np.asarray(s, np.float32), int(y)) for i, s, y in zip(made["ids"], made["shares"], made["_label"], strict=True)])
    del made
    give_back()  # the driver lives on
    return model


def scorer(docs: DataFrame, model: Model | None):
    """A column of the score of a text: the share that softmax gives to label 1; a half where there was nothing to learn from."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(scored)(batches)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([0.5 if m is None else m.score(t) for t in texts], dtype=float)

    return score


def classify(docs: DataFrame, model: Model | None, text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `least` on); columns of those names are replaced.

    Whole texts are read, however long; a null text is an empty one, which has the score of a text without features;
    equal texts score alike; rows never move; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("score", "predicted")]
    made = docs.select(F.struct(*(F.col(c) for c in others)).alias("_row"), scorer(docs, model)(text).alias("_s"))
    return made.select(*(F.col("_row").getField(c).alias(c) for c in others), F.col("_s").alias("score"), (F.col("_s") >= least).cast("int").alias("predicted"))


COLUMNS = ["doc_id", "held_out", "score", "predicted"]
