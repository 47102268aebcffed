"""Quality of texts without labels: heuristic labellers, their accuracies, and a hashed linear scorer.

Each labeller votes 1 (good), -1 (bad) or 0 (no opinion) on a text from one of its features.  The counts of vote
patterns over all documents, at most three to the number of labellers, come to the driver, where
expectation-maximisation of a two-class model estimates how each labeller votes on either class; that gives every
pattern a posterior.  A linear scorer over hashed n-grams of characters is then trained on the posteriors of at most
SAMPLE documents of at most ALL_CHARS characters, drawn in hash order, and scores every whole text.

Null texts count as empty.  A text without a word gets the posterior of its votes like any other, and the scorer's
bias as its score.  Rows that repeat are scored alike.  Without any document nothing is trained.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm import grams
from lexloom.llm.common import held, in_portions, lean, small_batches, text_of
from lexloom.llm.shingles import word_hashes

SAMPLE, BITS, ORDERS = 4000, 16, (1, 2, 3)
#: Longer texts are trained on only where there are too few others; and the characters of all of them together.
LONG, ALL_CHARS = 100_000, 100_000_000
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "as", "on", "by", "this", "from", "are", "be", "at", "or",
    "le", "la", "les", "des", "du", "et", "un", "une", "en", "est", "que", "qui", "pour", "dans", "par", "sur",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auf",
    "el", "los", "las", "de", "y", "se", "con", "por", "su", "para", "no", "al",
]


NAMES = ["marks", "case", "bars", "shouts", "repeats", "words", "length", "sentences"]
_LETTER, _UPPER, _MARK, _SPACE, _STOP, _BAR = (1 << i for i in range(6))


def _tables():
    """Classes of code points, and the sorted hashes of the function words with what may follow them."""

    def made():
        kind = np.where(grams.letters(), _LETTER, 0).astype(np.uint8)
        kind[np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)] |= _UPPER
        for chars, flag in (("%*&$#@~^<>{}[]\\", _MARK), ("\0 \t\n\x0b\x0c\r", _SPACE), (".?!", _STOP), ("|•·", _BAR)):
            kind[[ord(c) for c in chars]] |= flag
        known = [(w + end).encode() for w in FUNCTION_WORDS for end in ("", ".", ",", ";", ":")]
        return kind, np.unique(word_hashes(known)[0])

    return held("classes", made)


def votes_of(texts: list[str]) -> np.ndarray:
    """A row a text, a column for each of NAMES: 1, -1 or 0."""
    kind, known = _tables()
    out = np.zeros((len(texts), len(NAMES)), np.int8)
    for a, b in in_portions(texts, 1_000_000):
        points, at = grams.code_points(texts[a:b])
        own = kind[points]
        total = lambda mask: np.add.reduceat(mask.astype(np.int64), at[:-1])  # noqa: E731, B023
        flag = lambda f: (own & f) != 0  # noqa: E731, B023
        space = flag(_SPACE)
        before, after = np.concatenate([[True], space[:-1]]), np.concatenate([space[1:], [True]])
        words = np.maximum(1, total(~space & before))
        letters = np.maximum(1, total(flag(_LETTER)))
        size = np.maximum(1, np.diff(at) - 1)
        loud = (points == 33) | (points == 63)
        pair = np.concatenate([loud[:-1] & (points[1:] == points[:-1]), [False]])
        hashes, of = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts[a:b]])
        same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])]) if len(hashes) else np.zeros(0, bool)
        run = same & (np.concatenate([[False], same[:-1]]) | np.concatenate([same[1:], [False]]))
        share = lambda mask: np.bincount(of[mask], minlength=b - a) / words  # noqa: E731, B023
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        upper, marks, length = total(flag(_UPPER)) / letters, total(flag(_MARK)) / size, letters / words
        bars, shouts = total(flag(_BAR) & before & after) / words, total(pair & ~np.concatenate([[False], pair[:-1]])) / words
        repeats, function, stops = share(run), share(known[place] == hashes), total(flag(_STOP) & after)
        good_bad = [
            (marks < 0.01, marks > 0.05), (upper < 0.15, upper > 0.4), (bars == 0, bars > 0.1), (shouts == 0, shouts > 0.1), (repeats < 0.02, repeats > 0.06),
            (function > 0.15, (function < 0.03) & (words > 20)), ((length >= 3) & (length <= 9), (length > 14) | (length < 2)),
            ((stops > 0) & (words / np.maximum(1, stops) < 40), (stops == 0) & (words > 60)),
        ]
        out[a:b] = np.stack([np.where(bad, -1, np.where(good, 1, 0)) for good, bad in good_bad], axis=1)
    return out


def pattern_codes(texts: list[str]) -> np.ndarray:
    """A text's votes as one number in base three."""
    return (votes_of(texts).astype(np.int64) + 1) @ (3 ** np.arange(len(NAMES)))


def pattern(code: int) -> tuple:
    return tuple(code // 3**i % 3 - 1 for i in range(len(NAMES)))


#: Labellers that each name a kind of bad text of its own; the others only lend evidence.
KINDS = ("marks", "case", "bars", "shouts", "repeats")


def estimate(patterns: dict[tuple, int], names: list[str], rounds: int = 100) -> tuple[dict[tuple, float], dict]:
    """Posterior of good for each vote pattern, and each labeller's estimated accuracy (None where it never votes).

    The latent classes are good texts and one kind of bad texts for each of KINDS, since a bad text seldom is bad in
    every way; given the class, labellers vote independently, and no opinion is no evidence.
    """
    k, kinds = len(names), [names.index(x) for x in KINDS if x in names]
    # prior: as many good votes on good texts, from each labeller that names a kind, as there are texts
    total, post = sum(patterns.values()), {}
    for v in patterns:
        bad = [1.0 if v[i] < 0 else 0.0 for i in kinds]
        share = 0.95 if sum(bad) else 0.05
        post[v] = [1 - share, *(share * (x if sum(bad) else 1.0) / (sum(bad) or len(bad)) for x in bad)]
    for _ in range(rounds):
        mass = [1.0] * (1 + len(kinds))
        rate = [[{x: 0.5 for x in (-1, 1)} for _ in range(k)] for _ in mass]
        for i in kinds:
            rate[0][i][1] += total
        for v, n in patterns.items():
            for c, p in enumerate(post[v]):
                mass[c] += n * p
                for i, x in enumerate(v):
                    if x:
                        rate[c][i][x] += n * p
        logs = [[{x: math.log(n / sum(r.values())) for x, n in r.items()} for r in own] for own in rate]
        for v in post:
            log = [math.log(mass[c]) + sum(logs[c][i][x] for i, x in enumerate(v) if x) for c in range(len(mass))]
            top = max(log)
            weight = [math.exp(x - top) for x in log]
            post[v] = [x / sum(weight) for x in weight]
    good = {v: p[0] for v, p in post.items()}
    accuracy = {}
    for i, name in enumerate(names):
        voted = sum(n for v, n in patterns.items() if v[i])
        right = sum(n * (good[v] if v[i] > 0 else 1 - good[v]) for v, n in patterns.items() if v[i])
        accuracy[name] = right / voted if voted else None
    return good, accuracy


def repeated_share(texts: list[str]) -> np.ndarray:
    """Share of each text's words that equal the word before them, tenfold, at most 1."""
    words, of = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    same = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    share = np.bincount(of[1:][same], minlength=len(texts)) / np.maximum(1, np.bincount(of, minlength=len(texts)))
    return np.minimum(1, 10 * share)


class Scorer:
    """Logistic scorer over mean weights of hashed n-grams and the share of repeated words, in a place of its own."""

    def __init__(self, texts: list[str], target: np.ndarray, rounds: int = 300, decay: float = 1e-3):
        rows, columns, values = [], [], []
        for i, (h, _) in enumerate(self._hashed(texts)):
            seen, many = np.unique(h, return_counts=True)
            rows.append(np.full(len(seen), i))
            columns.append(seen)
            values.append(many / max(1, len(h)))
        n, width = len(texts), (1 << BITS) + 1
        rows, columns, values = map(np.concatenate, ([*rows, np.arange(n)], [*columns, np.full(n, width - 1)], [*values, np.concatenate([repeated_share(texts[a:b]) for a, b in in_portions(texts, 1_000_000)])]))
        # features in units of their spread; those of few texts are left out
        often = np.bincount(columns, minlength=width) >= max(3, n // 400)
        mean = np.bincount(columns, values, width) / n
        spread = np.sqrt(np.maximum(0, np.bincount(columns, values**2, width) / n - mean**2))
        scale = np.where(often & (spread > 0), 1 / np.maximum(spread, 1e-9), 0)
        scale[-1] *= 8  # one place against thousands
        values = values * scale[columns]
        shift = mean * scale
        # classes weigh alike
        good = max(1e-6, target.mean())
        weight = target / good + (1 - target) / max(1e-6, 1 - good)
        weight /= weight.sum()
        w, bias = np.zeros(width), 0.0
        step = 4.0 / max(1, int((scale > 0).sum())) ** 0.5
        for _ in range(rounds):
            f = np.bincount(rows, values * w[columns], n) - shift @ w + bias
            gap = weight * (1 / (1 + np.exp(-np.clip(f, -50, 50))) - target)
            slope = np.bincount(columns, values * gap[rows], width) - shift * gap.sum()
            w -= step * (slope + decay * w)
            bias -= step * gap.sum() * 10
        self.bias, self.weights = float(bias - shift @ w), (w * scale).astype(np.float32)

    @staticmethod
    def _hashed(texts: list[str]):
        """Hashed n-grams of each text."""
        for a, b in in_portions(texts, 1_000_000):
            points, at = grams.code_points(texts[a:b])
            hashes = [grams.gram_hashes(points, n, BITS) for n in ORDERS]
            for i in range(b - a):
                yield np.concatenate([h[at[i] : max(at[i], at[i + 1] - n)] for n, h in zip(ORDERS, hashes, strict=True)]), i

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in in_portions(texts, 1_000_000):
            points, at = grams.code_points(texts[a:b])
            total, many = np.zeros(b - a), np.zeros(b - a)
            for n in ORDERS:
                w = np.concatenate([[0], np.cumsum(self.weights[grams.gram_hashes(points, n, BITS)], dtype=np.float64)])
                upto = np.maximum(at[:-1], at[1:] - n)
                total += w[np.minimum(upto, len(w) - 1)] - w[np.minimum(at[:-1], len(w) - 1)]
                many += upto - at[:-1]
            out[a:b] = total / np.maximum(1, many) + self.weights[-1] * repeated_share(texts[a:b])
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -50, 50)))


def quality(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """doc_id, posterior (of the votes), score (of the trained scorer, 0 to 1), good (score of at least 0.5)."""
    out = f"{key} {docs.schema[key].dataType.simpleString()}, posterior double, score double, good boolean"
    texts = small_batches(docs.select(text_of().alias("text")))

    def vote(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pattern_codes(batch.column(0).to_pylist()))], names=["code"])

    counted = texts.mapInArrow(lean(vote), "code bigint").groupBy("code").agg(F.count("*").alias("n")).collect()
    if not counted:
        return docs.sparkSession.createDataFrame([], out)
    patterns = dict(sorted((pattern(r["code"]), r["n"]) for r in counted))
    post, _ = estimate(patterns, NAMES)
    posterior = np.full(3 ** len(NAMES), 0.5)
    for v, p in post.items():
        posterior[sum((x + 1) * 3**i for i, x in enumerate(v))] = round(p, 9)
    # distinct texts, as all copies of a text pass or fail the thinning together
    total = texts.agg(F.countDistinct(F.xxhash64("text"))).first()[0]
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    near = texts.withColumn("h", h).where(F.col("h") < min(1.0, 4 * sample / total + 100 / total) * (1 << 30))
    first = near.dropDuplicates(["h", "text"]).withColumn("long", F.length("text") > LONG).orderBy("long", "h", "text").limit(sample)
    spent = F.sum(F.length("text")).over(Window.orderBy("long", "h", "text").rowsBetween(Window.unboundedPreceding, -1))  # of at most `sample` rows
    drawn = [r["text"] for r in first.withColumn("spent", F.coalesce(spent, F.lit(0))).where(F.col("spent") < ALL_CHARS).orderBy("long", "h", "text").select("text").collect()]
    scorer = Scorer(drawn, posterior[pattern_codes(drawn)])
    model = docs.sparkSession.sparkContext.broadcast((scorer, posterior))  # 2^BITS weights and 3^labellers posteriors

    def run(batches):
        scorer, posterior = model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score = scorer.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(posterior[pattern_codes(texts)]), pa.array(score), pa.array(score >= 0.5)], names=[key, "posterior", "score", "good"])

    return docs.select(key, text_of().alias("text")).mapInArrow(lean(run), out)
