"""Words of several syllables: a lexicon learnt from a corpus, and the best path through its lattice.

A run is a stretch of syllables (letters only) with single spaces between them; everything else in a text stays where
it is.  Candidates for the lexicon are stretches of up to MOST syllables that stand often enough and whose parts meet more often
than by chance (else the longest stretches would always explain a corpus best); a word's probability
starts as its share of all stretches and is estimated anew by expectation-maximisation: a pass over the corpus sums up
how often each word is expected among all ways to cut each run, words that are hardly expected go.  A run is then cut
into the words whose probabilities have the greatest product; of equal cuts the one whose last word is longer counts.
Case is ignored.  The lexicon's size is a parameter, so it fits a worker however large the corpus is.

Texts are worked on many at a time, as arrays of their code points and syllables; a lattice's steps are taken for all
runs at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import legal_text as L
from lexloom.operators import encoding, tables

#: Syllables of a word at most; how often a stretch must stand; words of one and of several syllables that are kept.
MOST, LEAST, LEXICON = 4, 5, 50_000
#: How many times as often as by chance the parts of a word must stand together, wherever it is parted.
COHESION = 5.0
#: Syllables of which a task counts the stretches before it passes them on.
LOT = 1 << 19
#: Code points of the texts that are worked on at a time.
TEXTS = 1 << 21
#: Stretches by which the next longer ones are chosen.
HELD = 1 << 20
#: Syllables of a run beyond which it is gone through by itself.
LONG = 256
_RUN = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)*")


def runs_of(text: str | None) -> Iterator[list[str]]:
    for run in _RUN.finditer((text or "").lower()):
        yield run[0].split(" ")


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points a syllable is made of."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    out, every = np.zeros(0x110000, bool), np.array(points)
    for stretch in re.finditer(r"[^\W\d_]+", "".join(map(chr, points))):
        out[every[stretch.start() : stretch.end()]] = True
    return out


@dataclass
class Syllables:
    """The syllables of a text: where they begin and end, which of them go on a run, their numbers among the names."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    follows: np.ndarray
    ids: np.ndarray
    names: pa.Array

    @classmethod
    def of(cls, text: str) -> Syllables:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
        letter = _letters()[codes]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]])))
        starts, ends = edges[::2], edges[1::2]
        follows = np.zeros(len(starts), bool)
        follows[1:] = (starts[1:] == ends[:-1] + 1) & (codes[ends[:-1]] == 32)
        own = codes[letter]
        upto = np.concatenate([[0], np.cumsum(1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000))])
        offsets = upto[np.concatenate([[0], np.cumsum(ends - starts)])].astype(np.int64)
        data = own.tobytes().decode("utf-32-le").encode()
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        return cls(codes, starts, ends, follows, found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.string()))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First syllable and size of each run."""
        first = np.flatnonzero(~self.follows)
        return first, np.diff(np.append(first, len(self.ids)))


def _lots(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in lots of some TEXTS code points."""
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text or "")
        if size >= TEXTS:
            yield own
            own, size = [], 0
    if own:
        yield own


def _lowered(batch: pa.RecordBatch) -> Iterator[Syllables]:
    # a line end parts runs
    for lot in _lots((text or "").lower() for text in batch.column(0).to_pylist()):
        yield Syllables.of("\n".join(lot))


def _found(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Places of values among others; -1 where they are not."""
    return pc.fill_null(pc.index_in(values, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _at_least(sizes: np.ndarray) -> np.ndarray:
    """How many sizes are at least 0, 1, 2 ..."""
    return np.cumsum(np.bincount(sizes)[::-1])[::-1]


@dataclass
class Lexicon:
    """Words with their log probabilities, as a trie of syllables; a syllable it lacks stands for itself."""

    words: list[str]
    logs: list[float]
    unknown: float

    def __post_init__(self):
        self.root: dict = {}
        for i, word in enumerate(self.words):
            own = [-1, self.root]
            for syllable in word.split(" "):
                own = own[1].setdefault(syllable, [-1, {}])
            own[0] = i
        # the trie as arrays, a level for each syllable of a word: key of a node (node before it, syllable), number of its word
        parts = [(word.split(" "), i) for i, word in enumerate(self.words)]
        names = sorted({x for own, _ in parts for x in own})
        place, width = {x: i for i, x in enumerate(names)}, max(1, len(names))
        self.syllables, self.keys, self.numbers = pa.array(names, pa.string()), [], []
        nodes, size = [place[own[0]] for own, _ in parts], len(names)
        for n in range(1, MOST + 1):
            numbers, level, left, below = np.full(size, -1, np.int64), {}, [], []
            for (own, i), node in zip(parts, nodes, strict=True):
                if len(own) == n:
                    numbers[node] = i
                else:
                    left.append((own, i))
                    below.append(level.setdefault(node * width + place[own[n]], len(level)))
            self.numbers.append(numbers)
            self.keys.append(pa.array(level.keys(), pa.int64()))
            parts, nodes, size = left, below, len(level)
        self.weights = np.array([*self.logs, self.unknown])

    def edges(self, run: list[str]) -> list[list[tuple[int, int]]]:
        """For each place the (end, number) of the words that begin there, shorter first; -1: an unknown syllable."""
        out = []
        for i in range(len(run)):
            node, own = self.root, []
            for j in range(i, min(len(run), i + MOST)):
                step = node.get(run[j])
                if j == i and (step is None or step[0] < 0):
                    own.append((j + 1, -1))
                if step is None:
                    break
                if step[0] >= 0:
                    own.append((j + 1, step[0]))
                node = step[1]
            out.append(own)
        return out

    def log(self, number: int) -> float:
        return self.logs[number] if number >= 0 else self.unknown

    def cut(self, run: list[str]) -> list[int]:
        """The places where words end, on the best path."""
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for i, own in enumerate(self.edges(run)):
            for j, number in own:
                score = best[i] + self.log(number)
                if score > best[j]:
                    best[j], back[j] = score, i
        ends = [len(run)]
        while back[ends[-1]]:
            ends.append(back[ends[-1]])
        return ends[::-1]

    def expected(self, run: list[str]) -> Counter:
        """How often each known word is expected in a run, over all cuts by their probabilities."""
        edges, n = self.edges(run), len(run)
        ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        ahead[0] = behind[n] = 0.0
        for i in range(n):
            for j, number in edges[i]:
                ahead[j] = _both(ahead[j], ahead[i] + self.log(number))
        for i in range(n - 1, -1, -1):
            for j, number in edges[i]:
                behind[i] = _both(behind[i], self.log(number) + behind[j])
        out: Counter = Counter()
        for i in range(n):
            for j, number in edges[i]:
                if number >= 0:
                    out[number] += math.exp(ahead[i] + self.log(number) + behind[j] - ahead[n])
        return out

    def lattice(self, names: pa.Array, own: Syllables) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, logs) of the words of 1 to MOST syllables that begin at each syllable.

        The number is -1 where there is no word; a syllable that is none has a log all the same.
        """
        known = _found(names, self.syllables)[own.ids]
        numbers, logs = np.full((MOST, len(known)), -1, np.int64), np.full((MOST, len(known)), -np.inf)
        at = np.flatnonzero(known >= 0)
        node = known[at]
        for n in range(MOST):
            if n:
                at, node = (x[at + n < len(known)] for x in (at, node))
                on = own.follows[at + n] & (known[at + n] >= 0)
                at, node = at[on], node[on]
                node = _found(pa.array(node * len(self.syllables) + known[at + n]), self.keys[n - 1])
                at, node = at[node >= 0], node[node >= 0]
            numbers[n, at] = self.numbers[n][node]
            logs[n] = np.where(numbers[n] >= 0, self.weights[numbers[n]], self.unknown if n == 0 else -np.inf)
        return numbers, logs

    def add_expected(self, own: Syllables, into: np.ndarray) -> None:
        """Add to each word how often it is expected in all runs.

        A run is gone through in parts over whose bounds no word reaches; a syllable alone is its only cut.
        """
        numbers, logs = self.lattice(own.names, own)
        inner = np.zeros(len(own.ids) + 1, bool)
        for n in range(1, MOST):
            at = np.flatnonzero(numbers[n] >= 0)
            for k in range(1, n + 1):
                inner[at + k] = True
        first = np.flatnonzero(~inner[:-1])
        sizes = np.diff(np.append(first, len(own.ids)))
        alone = numbers[0, first[sizes == 1]]
        into += np.bincount(alone[alone >= 0], minlength=len(into))
        for start, size in zip(first[sizes > LONG], sizes[sizes > LONG], strict=True):
            run = own.names.take(pa.array(own.ids[start : start + size])).to_pylist()
            for number, n in self.expected(run).items():
                into[number] += n
        some = (sizes > 1) & (sizes <= LONG)
        first, sizes = first[some], sizes[some]
        if not len(first):
            return
        order = np.argsort(-sizes, kind="stable")
        first, sizes = first[order], sizes[order]
        upto, active = first + sizes, _at_least(sizes)
        # ahead of a syllable's end, behind its beginning; outside a part nothing is added
        ahead, behind = np.zeros(len(own.ids)), np.zeros(len(own.ids))
        for p in range(1, sizes[0] + 1):
            i, j = first[: active[p]] + p - 1, upto[: active[p]] - p
            reach = range(min(p, MOST))
            ahead[i] = _sum([logs[n, i - n] + (ahead[i - n - 1] if n + 1 < p else 0.0) for n in reach])
            behind[j] = _sum([logs[n, j] + (behind[j + n + 1] if n + 1 < p else 0.0) for n in reach])
        part = np.repeat(np.arange(len(first)), sizes)
        at = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[part]
        before = np.where(at == first[part], 0.0, ahead[at - 1]) - ahead[upto[part] - 1]
        for n in range(MOST):
            has = numbers[n, at] >= 0
            i = at[has]
            after = np.where(i + n + 1 == upto[part[has]], 0.0, behind[np.minimum(i + n + 1, len(behind) - 1)])
            into += np.bincount(numbers[n, i], np.exp(before[has] + logs[n, i] + after), minlength=len(into))

    def begins(self, own: Syllables) -> np.ndarray:
        """Which syllables begin a word on the best path of their run."""
        names = [x.lower() for x in own.names.to_pylist()]
        logs = self.lattice(pa.array(names, pa.string()), own)[1]
        out = np.zeros(len(own.ids) + 1, bool)
        first, sizes = own.runs()
        for start, size in zip(first[sizes > LONG], sizes[sizes > LONG], strict=True):
            out[start + np.array([0, *self.cut([names[i] for i in own.ids[start : start + size]])])] = True
        some = sizes <= LONG
        order = np.argsort(-sizes[some], kind="stable")
        first, sizes = first[some][order], sizes[some][order]
        if not len(first):
            return out[:-1]
        active = _at_least(sizes)
        # the best sum up to a syllable's end, and the syllables of its last word
        best, last = np.zeros(len(own.ids)), np.ones(len(own.ids), np.int64)
        for p in range(1, sizes[0] + 1):
            i = first[: active[p]] + p - 1
            for n in range(min(p, MOST), 0, -1):
                score = logs[n - 1, i - n + 1] + (best[i - n] if n < p else 0.0)
                if n == min(p, MOST):
                    top, size = score, np.full(len(i), n)
                else:
                    size = np.where(score > top, n, size)
                    top = np.maximum(score, top)
            best[i], last[i] = top, size
        at = first + sizes
        while len(at):
            at = at - last[at - 1]
            out[at] = True
            on = at > first
            at, first = at[on], first[on]
        return out[:-1]

    def all_segmented(self, texts: list[str | None]) -> list[str | None]:
        """Each text with an underscore between the syllables of a word."""
        own = Syllables.of("\n".join(t or "" for t in texts))
        own.codes[own.starts[~self.begins(own)] - 1] = ord("_")
        whole, at, out = own.codes.tobytes().decode("utf-32-le"), 0, []
        for text in texts:
            out.append(None if text is None else whole[at : at + len(text)])
            at += len(text or "") + 1
        return out

    def segmented(self, text: str | None) -> str | None:
        """text with an underscore between the syllables of a word."""

        def own(run):
            syllables = run[0].split(" ")
            ends = self.cut([s.lower() for s in syllables])
            return " ".join("_".join(syllables[a:b]) for a, b in pairwise([0, *ends]))

        return None if text is None else _RUN.sub(own, text)


def _both(a: float, b: float) -> float:
    """log(e^a + e^b)"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _sum(logs: list[np.ndarray]) -> np.ndarray:
    """log of the sum of e^x; the first is a number"""
    if len(logs) == 1:
        return logs[0]
    most = np.maximum.reduce(logs)
    return most + np.log(sum(np.exp(x - most) for x in logs))


#: Of a number of syllables: the stretches of which longer ones are made that are asked for.
Parts = dict[int, pa.Array]


def _counts(own: Syllables, low: int, high: int, sizes: range, parts: Parts) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(stretches, how often they stand) of each size, of those that begin from one syllable on and before another."""
    upto = min(len(own.ids), high + MOST - 1)
    ids, follows, names = own.ids[low:upto], own.follows[low:upto], own.names
    # the stretch at each place, as a number among the names; -1: none
    at, node, words = np.arange(len(ids)), ids, names
    for n in range(1, sizes[-1] + 1):
        if n > 1:
            there = np.full(len(ids) + 1, -1, np.int64)
            there[at] = node
            on = at + n - 1 < len(ids)
            at, node = at[on], node[on]
            on = follows[at + n - 1]
            if n - 1 in parts:
                good = np.append(_found(words, parts[n - 1]) >= 0, False)
                on &= good[node] & good[there[at + 1]]
            at, node = at[on], node[on]
            key = pa.array(node * len(names) + ids[at + n - 1]).dictionary_encode()
            made = key.dictionary.to_numpy()
            node = key.indices.to_numpy().astype(np.int64)
            words = pc.binary_join_element_wise(words.take(pa.array(made // len(names))), names.take(pa.array(made % len(names))), " ") if len(made) else pa.array([], pa.string())
        if n in sizes:
            n_of = np.bincount(node[at < high - low], minlength=len(words))
            some = np.flatnonzero(n_of)
            yield words.take(pa.array(some)), n_of[some]


def _stretches(df: DataFrame, text: str, sizes: range = range(1, MOST + 1), parts: Parts | None = None) -> DataFrame:
    """word, n: how often each stretch of some numbers of syllables stands; with parts, of those that are made of them."""

    def run(batches):
        # counts go on to the next step in lots, whatever a batch or a text holds
        for batch in batches:
            for own in _lowered(batch):
                for low in range(0, len(own.ids), LOT):
                    for words, n in _counts(own, low, low + LOT, sizes, parts or {}):
                        yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])

    return df.select(F.col(text)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learnt(df: DataFrame, text: str = "text", rounds: int = 4, least: int = LEAST, size: int = LEXICON) -> Lexicon:
    """The lexicon of a corpus: at most `size` syllables and `size` words of several, each standing `least` times.

    A longer stretch stands no more often than its parts, so only those are counted whose parts stand as often as the
    last of the best so far, ties included; where that leaves more than HELD parts, all are counted.
    """
    several = F.contains("word", F.lit(" "))
    best = lambda rows: rows.orderBy(F.desc("n"), "word").limit(size).collect()
    stretches = tables.written(_stretches(df, text, range(1, 3)).where((F.col("n") >= least) | ~several), "stretches")
    single, found, parts = best(stretches.where(~several)), best(stretches.where(several)), {}
    for n in range(3, MOST + 1):
        edge = found[-1]["n"] if len(found) == size else least
        held = stretches.where(several & (F.col("n") >= edge)).select("word").limit(HELD + 1).toArrow().column(0).combine_chunks()
        if len(held) <= HELD:
            parts[n - 1] = held
        tables.forgotten(stretches)
        stretches = tables.written(_stretches(df, text, range(n, n + 1), parts).where(F.col("n") >= edge), "stretches")
        # Spark's order of words, which is that of their bytes
        found = sorted([*found, *best(stretches)], key=lambda r: (-r["n"], r["word"].encode()))[:size]
    tables.forgotten(stretches)
    counts = {r["word"]: float(r["n"]) for r in [*found, *single]}
    total = sum(n for w, n in counts.items() if " " not in w)
    counts = {w: n for w, n in counts.items() if all(n * total >= COHESION * counts.get(a, 0) * counts.get(b, 0) for a, b in _parted(w))}
    for _ in range(rounds):
        lexicon = _of(counts)

        def add(batch, into, lexicon=lexicon):
            for own in _lowered(batch):
                lexicon.add_expected(own, into[: len(lexicon.words), 0])

        found = encoding.summed(df.select(F.col(text)), add, (max(1, len(lexicon.words)), 1))[:, 0]
        counts = {w: float(n) for w, n in zip(lexicon.words, found, strict=False) if n >= (least if " " in w else 1e-6)}
    return _of(counts)


def _parted(word: str) -> Iterator[tuple[str, str]]:
    at = word.find(" ")
    while at >= 0:
        yield word[:at], word[at + 1 :]
        at = word.find(" ", at + 1)


def _of(counts: dict[str, float]) -> Lexicon:
    words, total = sorted(counts), math.log(sum(counts.values()) + 1)
    return Lexicon(words, [math.log(counts[w]) - total for w in words], math.log(0.5) - total)


def segmented(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """df with its texts segmented; other columns stay."""
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            done = 0
            for lot in _lots(batch.column(at).to_pylist()):
                rows = batch.slice(done, len(lot))
                done += len(lot)
                own = pa.array(lexicon.all_segmented(lot), pa.string())
                yield pa.RecordBatch.from_arrays([own if i == at else rows.column(i) for i in range(rows.num_columns)], names=rows.schema.names)

    return df.mapInArrow(run, df.schema)


def cleaned(df: DataFrame, lexicon: Lexicon, text: str = "text", stopwords: list[str] | None = None, keep_underscore: bool = True) -> DataFrame:
    """df with its texts cleaned and segmented; stop words, of one syllable or several, go if they are given."""
    own = segmented(df.withColumn(text, L.spaced(F.col(text))), lexicon, text)
    return own.withColumn(text, L.kept(F.col(text), stopwords, keep_underscore))
