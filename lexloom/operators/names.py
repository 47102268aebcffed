"""An index of act names that a worker holds: which name does a mention's wording mean?

Names inside a wording are found by one automaton over all names, names that hold the wording by their rarest run of
GRAM characters, and names that share words by lists of names a word; frequent words cost a list's length, not a key's
rows.  Only registries of a checked size are held; see citations.name_matches for the others.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names, and characters of all names, of a registry that is held.
NAMES, NAME_CHARS = 200_000, 20_000_000
GRAM = 4
#: Wordings whose answers a task remembers.
REMEMBERED = 100_000


class NameIndex:
    """rows: (act_code, year or None, name, kind of the name)."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: r[0])  # of equal scores and years the smaller code comes first
        self.codes, self.names = [r[0] for r in rows], [r[2] for r in rows]
        self.years = np.array([-1 if r[1] is None else r[1] for r in rows], np.int64)
        self.kinds = np.array([r[3] for r in rows], dtype=object)
        self.lengths = np.array([len(n) for n in self.names], np.int64)
        same, words, grams = defaultdict(list), defaultdict(list), defaultdict(list)
        for i, name in enumerate(self.names):
            same[name].append(i)
            for word in set(name.split(" ")):
                words[word].append(i)
            for gram in {name[j : j + GRAM] for j in range(max(1, len(name) - GRAM + 1))}:
                grams[gram].append(i)
        self.words, self.grams = ({k: np.array(v) for k, v in table.items()} for table in (words, grams))
        self.automaton = ahocorasick.Automaton()
        for name, ids in same.items():
            self.automaton.add_word(name, ids)
        if same:
            self.automaton.make_automaton()

    def holding(self, core: str) -> np.ndarray:
        """Names that hold a wording."""
        if len(core) < GRAM:
            rows = range(len(self.names))
        else:
            lists = [self.grams.get(core[j : j + GRAM]) for j in range(len(core) - GRAM + 1)]
            if any(own is None for own in lists):
                return np.zeros(0, np.int64)
            rows = min(lists, key=len)
        return np.array([i for i in rows if core in self.names[i]], np.int64)

    def fits(self, rows: np.ndarray, kind: str | None) -> np.ndarray:
        if kind is None or not len(rows):
            return rows
        own = self.kinds[rows]
        return rows[(own == kind) | ((own == "bo luat") if kind == "luat" else False)]

    def best(self, core: str, kind: str | None, hint: int | None) -> tuple[str, int] | None:
        """(act_code, score) of the name that a wording means best; None where none shares anything with it."""
        if not self.names:
            return None
        holding = self.fits(self.holding(core), kind)
        inside = self.fits(np.array(sorted({i for _, ids in self.automaton.iter(core) for i in ids}), np.int64), kind)
        words = set(core.split(" "))
        parts = [(inside, self.lengths[inside]), (holding, np.full(len(holding), len(core)))]
        # a name that holds the wording outdoes what merely shares its words, unless the words are as many as letters
        if not len(holding) or len(core) - 1 <= len(words):
            lists = [self.words[w] for w in words if w in self.words]
            if lists:
                sharing, common = np.unique(np.concatenate(lists), return_counts=True)
                own = np.isin(sharing, self.fits(sharing, kind)) & ~np.isin(sharing, inside) & ~np.isin(sharing, holding)
                parts.append((sharing[own], common[own]))
        rows = np.concatenate([r for r, _ in parts])
        if not len(rows):
            return None
        scores = np.concatenate([s for _, s in parts])
        if hint is not None:
            scores = scores - (self.years[rows] != hint)
        at = np.lexsort((rows, -self.years[rows], -scores))[0]
        return self.codes[rows[at]], int(scores[at])


#: The index of this Python worker, by the broadcast that it was made of.
_HELD: dict = {}


def resolved(own: DataFrame, rows: list[tuple]) -> DataFrame:
    """mention_id, act_code, score for mentions (mention_id, year_hint, kind, core)."""
    shared = own.sparkSession.sparkContext.broadcast(rows)  # bounded by NAMES and NAME_CHARS
    schema = own.select("mention_id").schema.add("act_code", "string").add("score", "integer")

    def run(batches):
        if shared not in _HELD:
            _HELD.clear()
            _HELD[shared] = NameIndex(shared.value)
        index, known = _HELD[shared], {}
        for batch in batches:
            at, found = [], []
            for i, asked in enumerate(zip(*(batch.column(c).to_pylist() for c in ("core", "kind", "year_hint")), strict=True)):
                if asked not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[asked] = index.best(*asked)
                if known[asked] is not None:
                    at.append(i)
                    found.append(known[asked])
            yield pa.RecordBatch.from_arrays([batch.column("mention_id").take(pa.array(at, pa.int64())), pa.array([c for c, _ in found], pa.string()), pa.array([s for _, s in found], pa.int32())], names=schema.names)

    return own.select("mention_id", "year_hint", "kind", "core").mapInArrow(run, schema)


def held(names: DataFrame) -> list[tuple] | None:
    """The rows (act_code, year, name, name_kind) of a registry that is small enough to be held, else None."""
    many, chars = names.agg(F.count("*"), F.coalesce(F.sum(F.length("name")), F.lit(0))).first()
    if many > NAMES or chars > NAME_CHARS:
        return None
    return [tuple(r) for r in names.select("act_code", "year", "name", "name_kind").collect()]
