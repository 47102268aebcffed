"""Language identification by a string kernel.

The blended-spectrum presence kernel counts the n-grams of letters (n in ORDERS, hashed) that two texts share, over
the square root of the product of their numbers of n-grams.  Landmark texts give Nyström features, and one ridge
regression a language, against all others, is fitted in their space.  As the kernel is linear in the presence of
n-grams, a text's scores are one matrix product of its presence row with the folded weights; texts go in batches.

N-grams beyond the GRAMS that most landmarks have are left out of rows and norms alike, so the kernel is that of the
remembered n-grams.  Fitting uses at most PER_LANGUAGE labelled texts of each language (fewer where there are many languages: ALL_TEXTS
together), drawn in hash order, LANDMARKS of them as landmarks; the sample is the same whatever the partitions.  Only text and label are learnt from.

A null text or one without a letter is `und` with score 0; so is every text if nothing was learnt.  Score is the
softmax of the languages' values.  Rows that repeat are predicted alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import grams
from lexloom.llm.common import free, in_portions, lean, small_batches

ORDERS, BITS = (1, 2, 3), 20
PER_LANGUAGE, LANDMARKS, RIDGE, SHARPNESS = 600, 96, 1e-3, 6.0
#: Bounds over all languages together: texts, landmarks, and n-grams (those of most landmarks).
ALL_TEXTS, ALL_LANDMARKS, GRAMS = 6000, 1500, 1 << 15
#: Up to so many languages, their counts are broadcast to the texts.
MANY_LANGUAGES = 10_000
#: Longer texts are learnt from only where a language has too few others; and the characters of all texts together, but
#: one text a language is always there.
LONG, ALL_CHARS = 100_000, 100_000_000
UNKNOWN = "und"


def held_out(key: Column) -> Column:
    """Whether a document is held out; one without a key is not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> list:
    """(text, lang) of at most per_language texts a language.  labelled: text, lang."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"))
    # distinct texts, as all copies of a text pass or fail the thinning together
    counts = rows.groupBy("lang").agg(F.countDistinct("h").alias("n"))
    own = counts.limit(MANY_LANGUAGES + 1).collect()
    languages = len(own)
    if not languages:
        return []
    if languages <= MANY_LANGUAGES:
        counts = F.broadcast(labelled.sparkSession.createDataFrame(own, counts.schema))
    else:  # the counts join by shuffle, and so do the texts
        languages = counts.count()
    per_language = max(1, min(per_language, ALL_TEXTS // languages))
    # first thin out by hash, so that little text is shuffled; then take exactly the first in hash order
    share = F.least(F.lit(1.0), (4.0 * per_language + 50.0) / F.col("n"))
    near = rows.join(counts, "lang").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang", "h")
    near = near.dropDuplicates(["lang", "h"])  # copies teach nothing
    place = Window.partitionBy("lang").orderBy(F.length("text") > LONG, F.pmod("h", F.lit(1 << 30)), "text")
    drawn = near.withColumn("n", F.row_number().over(place)).where(F.col("n") <= per_language)
    # at most ALL_TEXTS rows are left here
    spent = F.sum(F.length("text")).over(Window.orderBy("n", "lang").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    drawn = drawn.withColumn("spent", spent).where((F.col("spent") <= ALL_CHARS) | (F.col("n") == 1))
    return [(r["text"], r["lang"]) for r in drawn.orderBy("lang", "n").select("text", "lang").collect()]


def presence(texts: list[str], place: np.ndarray | None, width: int):
    """For each text the sorted distinct hashed n-grams, or, with place, a 0/1 row over the places of known n-grams."""
    points, at = grams.code_points([t.lower() for t in texts])
    points = grams.letters_only(points)
    hashes = [grams.gram_hashes(points, n, BITS) for n in ORDERS]
    out = [] if place is None else np.zeros((len(texts), width + 1), np.uint8)
    for i in range(len(texts)):
        for n, h in zip(ORDERS, hashes, strict=True):
            own = h[at[i] : max(at[i], at[i + 1] - n)]
            if place is None:
                out.append(np.unique(own))
            else:
                out[i, place[own]] = 1
    if place is not None:
        return out[:, :width]
    k = len(ORDERS)
    return [np.unique(np.concatenate(out[k * i : k * i + k])) for i in range(len(texts))]


class KernelModel:
    """Folded weights of the one-versus-rest regressions over the landmarks' n-grams."""

    def __init__(self, sample: list, landmarks: int = LANDMARKS, ridge: float = RIDGE):
        sample = [(t, lang) for t, lang in sample if any(map(str.isalpha, t))]
        self.languages = sorted({lang for _, lang in sample})
        if not sample:
            return
        own = presence([t for t, _ in sample], None, 0)
        lang = np.array([self.languages.index(x) for _, x in sample])
        most = max(1, min(landmarks, ALL_LANDMARKS // len(self.languages)))
        chosen = np.concatenate([np.flatnonzero(lang == c)[:most] for c in range(len(self.languages))])
        known, often = np.unique(np.concatenate([own[i] for i in chosen]), return_counts=True)
        known = np.sort(known[np.argsort(-often, kind="stable")[:GRAMS]])
        self.width = len(known)
        self.place = np.full(1 << BITS, self.width, np.int32)
        self.place[known] = np.arange(self.width)
        marks = self._rows([own[i] for i in chosen])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        root = vectors / np.sqrt(np.maximum(values, 1e-6))
        features = np.concatenate([(self._rows(own[i : i + 256]) @ marks.T).astype(np.float64) for i in range(0, len(own), 256)]) @ root
        # languages weigh alike, however many texts each has
        weight = (1 / np.bincount(lang))[lang][:, None]
        target = np.where(lang[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        inner = features.T @ (weight * features) + ridge * np.eye(features.shape[1])
        # the mean of each target is fitted apart
        self.base = (weight * target).sum(axis=0) / weight.sum()
        alpha = root @ np.linalg.solve(inner, features.T @ (weight * (target - self.base)))
        self.weights = (marks.T.astype(np.float64) @ alpha).astype(np.float32)

    def _rows(self, sets: list[np.ndarray]) -> np.ndarray:
        """Presence rows of unit length of some n-gram sets."""
        x = np.zeros((len(sets), self.width + 1), np.float32)
        for i, g in enumerate(sets):
            x[i, self.place[g]] = 1
        x = x[:, : self.width]
        return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row a text, a column a language."""
        x = presence(texts, self.place, self.width).astype(np.float32)
        return x @ self.weights / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True))) + self.base

    def predict(self, texts: list[str | None]):
        """(language, score) lists."""
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        use = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        own = [texts[i] for i in use]
        for a, b in in_portions(own, 500_000):
            for c in range(a, b, 64):
                f = SHARPNESS * self.scores(own[c : min(b, c + 64)])
                p = np.exp(f - f.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                for i, j, q in zip(use[c : c + 64], best, p.max(axis=1), strict=False):
                    out[i], score[i] = self.languages[j], min(1.0, float(q))
        return out, score


def fit(docs: DataFrame, key: str = "doc_id") -> KernelModel:
    """Learn from the documents that are not held out."""
    return KernelModel(training_sample(docs.where(~held_out(F.col(key))).select("text", "lang")))


def predict(docs: DataFrame, model: KernelModel, text: str = "text", to: tuple = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score in new columns; columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in to]
    schema = docs.select(*kept).schema.add(to[0], "string").add(to[1], "double")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # a table of 2^BITS places and some thousand weights a language

    def run(batches):
        for batch in batches:
            lang, score = shared.value.predict(batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, *to])

    return small_batches(docs.select(*kept, F.col(text).alias(free(docs.columns, "own_text")))).mapInArrow(lean(run), schema)


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = docs.select(key, held_out(F.col(key)).alias("held_out"), "text")
    return predict(rows, fit(docs, key)).select(key, "held_out", "lang_pred", "score")
