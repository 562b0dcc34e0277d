"""Language ID: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotledger.llm.common import give_back, tidy

#: N-grams of one to so many code points.
SPECTRUM = 3
#: N-grams are told apart by so many bits of a hash.
BITS = 14
#: The bounds of the sample that is learned from, over all languages, and of the landmarks in it.
MAX_SAMPLE, LANDMARKS = 1600, 128
RIDGE, BATCH = 1e-2, 64
#: A filter rejects what the best machine scores lower: at half it is undecided, below it, it holds against.
MIN_SCORE = 0.35
UNKNOWN = "und"


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams occur in the whole text: lower case, any run of other characters than letters as one blank."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    seen, at = np.unique(codes, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in seen])
    codes = np.where(letters, seen, np.uint32(32))[at]
    codes = codes[(codes != 32) | np.append(True, codes[:-1] != 32)].astype(np.uint64)
    out, rolled = np.zeros(1 << BITS, np.float32), np.zeros(len(codes), np.uint64)
    for n in range(SPECTRUM):
        rolled = rolled[: len(codes) - n] * np.uint64(1_000_003) + codes[n:] + np.uint64(1)
        out[(rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)] = 1
    return out


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass(frozen=True)
class Model:
    """score = normalised presence x landmarks x weights, a column for each language."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, presences: np.ndarray) -> np.ndarray:
        return _unit(presences) @ self.landmarks @ self.weights


def _unit(presences: np.ndarray) -> np.ndarray:
    return presences / np.sqrt(np.maximum(1, presences.sum(axis=1, keepdims=True)))


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """texts in an order that doesn't hang on chance; landmarks are taken from the languages in turn."""
    names = sorted(set(languages))
    if not names:
        return None
    # Rows of bits; as numbers, four times their size, only BATCH of them at a time: the driver, which fits, has little memory.
    found = np.empty((len(texts), 1 << BITS), bool)
    for i, t in enumerate(texts):
        found[i] = presence(t)
    place = pd.Series(languages).groupby(languages).cumcount().to_numpy()
    chosen = np.lexsort((languages, place))[:landmarks]
    base = _unit(found[chosen].astype(np.float32))
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([_unit(found[i : i + BATCH].astype(np.float32)) @ base.T for i in range(0, len(found), BATCH)]).astype(np.float64) @ root
    target = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
    weights = root @ np.linalg.solve(phi.T @ phi + ridge * len(texts) * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ target)
    return Model(tuple(names), np.ascontiguousarray(base.T, np.float32), weights.astype(np.float32))


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_sample: int = MAX_SAMPLE) -> Model | None:
    """A model of the labelled rows that aren't held out: of each language the same number, those least by a digest of
    key and text, repeated rows once, max_sample rows at most in all. None if there is no such row."""
    usable = docs.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(max_sample).collect()}
    if not counts:
        return None
    each = max(1, max_sample // len(counts))
    mark = F.xxhash64(F.col(key).cast("string"), F.col(text)).cast("double") / 2.0**64 + 0.5
    share = F.create_map(*(x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, 2.0 * each / n + 20.0 / n)))))
    # About twice as many as needed come here; the number that is wanted of each language is then exact.
    near = usable.withColumn("_mark", mark).filter(F.col("_mark") < F.try_element_at(share, F.col(lang))).distinct()
    rows = near.toPandas().sort_values(["_mark", text], kind="stable").groupby(lang, sort=True).head(each)
    model = fit(rows[text].tolist(), rows[lang].tolist())
    del rows
    give_back()  # the driver lives on
    return model


def predictor(docs: DataFrame, model: Model | None):
    """A column of struct<lang_pred, score> from one of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(scored)(batches)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            for lo in range(0, len(todo), BATCH):
                at = todo[lo : lo + BATCH]
                found = m.scores(np.stack([presence(texts.iloc[i]) for i in at]))
                names[at] = np.array(m.languages, object)[found.argmax(axis=1)]
                scores[at] = np.clip((found.max(axis=1) + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1); columns of those names are replaced.

    A null text, one without a letter, or any text where there was nothing to learn from is "und" with score 0. Whole
    texts, however long, are read in batches, each scored by two matrix products; rows never move, repeated texts score
    alike, of languages with equal scores the first by name is taken, and an empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    named = docs.select(F.struct(*(F.col(c) for c in others)).alias("_row"), predictor(docs, model)(text).alias("_p"))
    return named.select(*(F.col("_row").getField(c).alias(c) for c in others), F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that are in a known language, with the columns of docs, whatever their names.

    Null texts, texts without letters, and all texts where no label was learnt, are in none. Repeated rows stay or go together.
    """
    named = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), predictor(docs, train(docs, key, text, lang))(text).alias("_p"))
    known = named.filter((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= min_score))
    return known.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


COLUMNS = ["doc_id", "held_out", "lang_pred", "score"]
