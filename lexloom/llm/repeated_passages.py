"""Passages of at least so many words that stand more than once, by prefix-partitioned suffix trees.

Words are runs of characters other than space and the control characters from tab to carriage return, unchanged.  A
window is a passage of `words` consecutive words of one text; every word of a window whose words also start anywhere
else, in the same text or another, is repeated.

Suffixes.  A window's anchor is the place in it with the least hash of GRAM words, the first of equal ones, so that
equal windows have their anchors at the same place.  Suffixes start at anchors, one of some eleven words; a suffix
carries along what stands before its anchor as far as windows of that anchor reach.  The windows of one anchor, one
after the other, are its run: their words, up to 2 * words - GRAM of them.

Groups.  Suffixes are split by their prefix of GRAM words.  A prefix that stands once has no repeat and goes at once;
runs equal as a whole are one from there on, with a count.  A prefix whose runs are all equal needs no tree, all its
windows are repeated.  Prefixes with up to GROUP different runs fit in memory: whole groups meet in a task, up to about
LOT_WORDS words at a time, and one suffix tree is built of each lot.  Longer prefixes split the others: windows that
begin up to half as many words before the anchor share what follows it for longer, the others share what stands before
it, and both halves are grouped anew by the words that all their windows share.  Prefixes that stand once go, groups
that fit get their tree, the rest is halved again; a prefix as long as a window is itself a node deep enough, and its
count says whether it has more than one leaf.

Trees.  The words of a lot's runs are numbered, suffixes are sorted by doubling, and neighbours' common prefixes give
the inner nodes: the outermost ones `words` or more deep, with their leaves, are the maximal repeats' windows.  The
comparison is by the words themselves; equal runs are found by 128 bits of hash (prefix and run).

Marks go back to the texts as (first window, bits of the windows that are repeated).  Texts are told apart by 64 bits of
hash of key and text; rows equal in both are told apart only in counts, as they share their marks.

Null and empty texts have no words; texts shorter than a window keep all.  Repeated rows are texts of their own, so that
both lose all that a window covers.  A null key is a key like others.  An empty table gives no row.  Very long texts are
worked on in pieces of a MB.  Extra columns come out as they were.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import in_portions, lean, mix64, small_batches, stored
from lexloom.llm.shingles import word_hashes

WORDS, GRAM = 35, 8
#: Different runs that share a prefix and still go to one tree (about LOT_WORDS words); words of a lot of groups.
GROUP, LOT_WORDS = 8192, 400_000
#: Bytes of a text that are worked on at a time.
PIECE = 1_000_000
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_ODD = [(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(256)]
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def pieces_of(text: str | None) -> list[bytes]:
    """A text's bytes, cut behind blanks about every MB."""
    raw, at, out = (text or "").encode("utf-8", "surrogatepass"), 0, []
    while len(raw) - at > PIECE:
        blank = _BLANK.search(raw, at + PIECE)
        if not blank:
            break
        out.append(raw[at : blank.start()])
        at = blank.end()
    return [*out, raw[at:]]


# ---------------------------------------------------------------- anchors


def _hashes(texts: list[str]):
    """(hash of every word, number of the text it is in) of texts that are worked on together."""
    cut = [pieces_of(t) for t in texts]
    owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    flat = list(chain.from_iterable(cut))
    words, of, at = [], [], 0
    for a, b in in_portions(flat, PIECE):
        h, piece = word_hashes(flat[a:b], lower=False)
        words.append(h)
        of.append(owner[a:b][piece])
        at += len(h)
    return np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *of])


def runs_of(texts: list[str], words: int = WORDS):
    """Runs of texts: text, first window (number of its first word in the text), windows, words before the anchor, hash
    of the prefix at the anchor, hash of all words of the run."""
    h, of = _hashes(texts)
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < words:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    with np.errstate(over="ignore"):
        gram = mix64(sum(h[i : n - GRAM + 1 + i] * np.uint64(_ODD[i]) for i in range(GRAM)), 3)
        count = n - words + 1
        anchor = np.argmin(np.lib.stride_tricks.sliding_window_view(gram, words - GRAM + 1), axis=1) + np.arange(count)
        start = np.flatnonzero(of[:count] == of[words - 1 :])
        at = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        a = start[first]
        b = start[np.append(first[1:], len(start))[: len(first)] - 1] + words
        # words weigh powers of a base, taken from a run's first word on
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, _INVERSE))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
        whole = mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64), 5)
    before = np.searchsorted(of, np.arange(len(texts)))
    return of[a], a - before[of[a]], b - a - words + 1, at[first] - a, gram[at[first]], whole


def _runs(docs: DataFrame, words: int) -> DataFrame:
    """g (prefix), r (run), k (text), s (first window), span (windows, and 64 times the words before the anchor)."""
    schema = "g long, r long, k long, s int, span int"

    def run(batches):
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("k").to_numpy()
            for a, b in in_portions([t or "" for t in texts], PIECE):
                of, s, many, ahead, g, r = runs_of(texts[a:b], words)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(r.view(np.int64)), pa.array(keys[a:b][of]), pa.array(s.astype(np.int32)), pa.array((64 * ahead + many).astype(np.int32))], names=["g", "r", "k", "s", "span"])

    return small_batches(docs).mapInArrow(lean(run), schema)


# ---------------------------------------------------------------- trees


def suffix_tree(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a sequence of numbers in order, and of each the length it shares with the one before it.

    Numbers below 0 end a string and differ from all others.  Only the first 2^p numbers of a suffix are compared, p
    the least with 2^p > 2 * least; strings are shorter.
    """
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    levels, width = [rank], 1
    while width <= 2 * least:
        behind = np.full(n, -1, np.int64)
        behind[: max(n - width, 0)] = levels[-1][width:]
        _, rank = np.unique(levels[-1] * (n + 1) + behind + 1, return_inverse=True)
        levels.append(rank)
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = levels[level][a[inside]] == levels[level][b[inside]]
        step = same * (1 << level)
        shared[1:] += step
        a, b = a + step, b + step
    return order, shared


def deep_nodes(order: np.ndarray, shared: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """Every inner node at least so deep: (its depth, the suffixes below it), outer nodes after their inner ones."""
    out, open_nodes = [], []
    for i in [*range(1, len(order)), len(order)]:
        depth, left = int(shared[i]) if i < len(order) else 0, i - 1
        while open_nodes and open_nodes[-1][0] > depth:
            deep, left = open_nodes.pop()
            out.append((deep, order[left:i]))
        if depth >= least and (not open_nodes or open_nodes[-1][0] < depth):
            open_nodes.append((depth, left))
    return out


def repeated_windows(runs: list[bytes], many: np.ndarray, group: np.ndarray, count: np.ndarray, words: int = WORDS) -> list[int]:
    """For each run the bits of its windows that stand more than once among the runs of its group."""
    split = [r.split() for r in runs]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    codes, _ = pd.factorize(np.array(list(chain.from_iterable(split)), dtype=object))
    # an end of its own behind each run
    ends = np.cumsum(sizes + 1) - 1
    ids = np.empty(int(sizes.sum()) + len(runs), np.int64)
    is_end = np.zeros(len(ids), bool)
    is_end[ends] = True
    ids[~is_end], ids[ends] = codes, -1 - np.arange(len(runs))
    order, shared = suffix_tree(ids, words)
    # leaves are windows; the outermost deep nodes are stretches of them that share so many words
    run_at = np.repeat(np.arange(len(runs)), sizes + 1)
    starts = ends - sizes
    leaf = np.flatnonzero(np.arange(len(ids))[order] - starts[run_at[order]] < many[run_at[order]])
    node = np.cumsum(shared < words)[leaf]
    place = order[leaf]
    own = run_at[place]
    # a node's leaves in one group: prefixes tell groups apart, except where two prefixes have one hash
    _, one = np.unique(node * (int(group.max()) + 1 if len(group) else 1) + group[own], return_inverse=True)
    leaves = np.bincount(one, weights=count[own])
    bits = np.zeros(len(runs), np.int64)
    again = leaves[one] > 1
    np.bitwise_or.at(bits, own[again], np.int64(1) << (place - starts[own])[again])
    return bits.tolist()


def _trees(groups: DataFrame, words: int) -> DataFrame:
    """of, r, bits for groups (g, of, r, c, many, skip, run): runs whose first `skip` windows were left out."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush(own):
            _, group = np.unique([x[0] for x in own], return_inverse=True)
            bits = repeated_windows([x[6] for x in own], np.array([x[4] for x in own]), group, np.array([x[3] for x in own]), words)
            columns = [x[1] for x in own], [x[2] for x in own], [b << x[5] for b, x in zip(bits, own, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["of", "r", "bits"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "of", "r", "c", "many", "skip", "run")), strict=True):
                if size >= LOT_WORDS and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += row[4] + words
        if held:
            yield flush(held)

    groups = groups.select("g", "of", "r", "c", "many", "skip", F.col("run").cast("binary").alias("run"))
    return small_batches(groups.repartition("g").sortWithinPartitions("g")).mapInArrow(lean(run), "of long, r long, bits long")


def _grown(groups: DataFrame, words: int) -> list[DataFrame]:
    """Frames of of, r, bits for groups (g, r, c, span, run) of too many runs, by ever longer prefixes.

    A row stands for the windows of a run that begin lo to hi words before the anchor; all of them hold the words from
    lo before the anchor on that they share, and these are the prefix.
    """
    ahead, many = F.shiftright("span", 6), F.col("span").bitwiseAND(63)
    rows = groups.select(F.col("g").alias("of"), "r", "c", ahead.alias("ahead"), many.alias("many"), F.lit(0).alias("lo"), F.lit(words - GRAM).alias("hi"), F.split(F.col("run").cast("string"), " ").alias("ws"))
    out = []
    while not rows.isEmpty():
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.filter(F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi"))), lambda h: (h["lo"] <= F.col("ahead")) & (h["hi"] > F.col("ahead") - F.col("many")))
        rows = rows.select("of", "r", "c", "ahead", "many", "ws", F.explode(halves).alias("half")).select("of", "r", "c", "ahead", "many", "ws", "half.lo", "half.hi")
        prefix = F.slice("ws", F.col("ahead") - F.col("lo") + 1, F.lit(words) - F.col("hi") + F.col("lo"))
        rows = rows.withColumns({"g": F.xxhash64("lo", "hi", prefix), "f": F.xxhash64(F.lit(1), "lo", "hi", prefix)})
        counts = rows.groupBy("g", "f").agg(F.sum("c").alias("leaves"), F.count("*").alias("runs")).where("leaves > 1")
        rows = stored(rows.join(counts, ["g", "f"]), "grown")
        out.append(rows.where("lo = hi").select("of", "r", F.expr("shiftleft(1L, ahead - lo)").alias("bits")))
        skip, last = F.greatest(F.lit(0), F.col("ahead") - F.col("hi")), F.least(F.col("many") - 1, F.col("ahead") - F.col("lo"))
        small = rows.where((F.col("lo") < F.col("hi")) & (F.col("runs") <= GROUP)).withColumns({"skip": skip, "last": last})
        run = F.array_join(F.slice("ws", F.col("skip") + 1, F.col("last") - F.col("skip") + words), " ")
        out.append(_trees(small.select("g", "of", "r", "c", (F.col("last") - F.col("skip") + 1).alias("many"), "skip", run.alias("run")), words))
        rows = rows.where((F.col("lo") < F.col("hi")) & (F.col("runs") > GROUP)).select("of", "r", "c", "ahead", "many", "lo", "hi", "ws")
    return out


# ---------------------------------------------------------------- from texts to marks


def _fetch(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """g, r, c, span, large and the words of each wanted run (k, s, span, g, r, c, large), read out of its text."""
    lists = wanted.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("s", "span", "g", "r", "c", "large"))).alias("asked"))
    schema = "g long, r long, c long, span int, large boolean, run binary"

    def cut(text, asked):
        """The bytes of each run asked for, by the number of its first word; a text is read a piece at a time."""
        kept, base, turn = [], 0, 0
        for piece in pieces_of(text):
            kept += piece.split()
            while turn < len(asked):
                x = asked[turn]
                a = x["s"] - base
                b = a + (x["span"] & 63) + words - 1
                if b > len(kept):
                    break
                yield x, b" ".join(kept[a:b])
                turn += 1
            drop = max(0, min((asked[turn]["s"] if turn < len(asked) else base + len(kept)) - base, len(kept)))
            kept, base = kept[drop:], base + drop

    def run(batches):
        for batch in batches:
            out = [(x["g"], x["r"], x["c"], x["span"], x["large"], run) for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True) for x, run in cut(text, asked)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["g", "r", "c", "span", "large", "run"])

    found = small_batches(docs.join(lists, "k").select("text", "asked")).mapInArrow(lean(run), schema)
    return found.dropDuplicates(["g", "r"])  # rows equal in key and text fetch the same


def marks(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """k, marks (first window, bits of the windows from there that are repeated), for docs (k, text)."""
    if not GRAM < words <= 64:
        raise ValueError(f"words must be {GRAM + 1} to 64")
    runs = _runs(docs, words)
    prefixes = runs.groupBy("g").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("most")).where("n > 1")
    alive = runs.join(prefixes, "g").select("g", "r", "k", "s", "span", (F.col("least") < F.col("most")).alias("mixed"), (F.col("n") > GROUP).alias("large"))
    alive = stored(alive, "suffixes")
    mixed = alive.where("mixed")
    classes = mixed.groupBy("g", "r").agg(F.count("*").alias("c"), F.min(F.struct("k", "s", "span")).alias("one"), F.first("large").alias("large"))
    fetched = stored(_fetch(docs, classes.select("one.*", "g", "r", "c", "large"), words), "runs")
    few, often = fetched.where("NOT large"), fetched.where("large")
    # prefixes that stand often may still have few different runs
    sizes = often.groupBy("g").agg(F.count("*").alias("runs"))
    often = often.join(sizes, "g")
    few = few.unionByName(often.where(F.col("runs") <= GROUP).drop("runs"))
    own = few.select("g", F.col("g").alias("of"), "r", "c", F.col("span").bitwiseAND(63).alias("many"), F.lit(0).alias("skip"), "run")
    bits = _trees(own, words)
    for frame in _grown(often.where(F.col("runs") > GROUP), words):
        bits = bits.unionByName(frame)
    bits = bits.where("bits <> 0").groupBy("of", "r").agg(F.bit_or("bits").alias("bits")).withColumnRenamed("of", "g")
    told = mixed.join(bits, ["g", "r"]).select("k", "s", "bits")
    plain = alive.where("NOT mixed").select("k", "s", F.expr("shiftleft(1L, span & 63) - 1").alias("bits"))
    return told.unionByName(plain).groupBy("k").agg(F.array_sort(F.collect_set(F.struct("s", "bits"))).alias("marks"))


def _key(key: str, text: str):
    return F.xxhash64(key, text)


def covered(marks_of: list[dict] | None, words: int, upto: int) -> np.ndarray:
    """Whether each of a text's words stands in a repeated window."""
    change = np.zeros(upto + 1, np.int64)
    for m in marks_of or ():
        bits, at = m["bits"], m["s"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            change[at + low] += 1
            change[at + low + words] -= 1
            bits &= bits - 1
    return np.cumsum(change[:-1]) > 0


def _kept(text: str | None, marks_of, words: int):
    """(words of each piece of a text that are kept, words in the piece), piece by piece."""
    pieces = [p.split() for p in pieces_of(text)]
    total = sum(map(len, pieces))
    gone = covered(marks_of, words, total) if marks_of else None
    at = 0
    for own in pieces:
        yield (own if gone is None else [w for w, x in zip(own, gone[at : at + len(own)], strict=True) if not x]), len(own)
        at += len(own)


def repeated_digest(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256 (of the words that are left, joined by a space) of every row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), _key(key, text).alias("k"))
    both = rows.join(marks(rows.select("k", "text"), words), "k", "left").select("key", "text", "marks")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def run(batches):
        for batch in batches:
            out = []
            for one, own in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                sha, n, kept = hashlib.sha256(), 0, 0
                for left, size in _kept(one, own, words):
                    if left:
                        sha.update((b" " if kept else b"") + b" ".join(left))
                    n, kept = n + size, kept + len(left)
                out.append((n, n - kept, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=schema.names)

    return small_batches(both).mapInArrow(lean(run), schema)


def without_repeats(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every repeated word taken out of the text; texts that lose none stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"), _key(key, text).alias("k"))
    both = rows.join(marks(rows.select("k", "text"), words), "k", "left").select("row", "text", "marks")
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            new = [one if not own else b" ".join(chain.from_iterable(left for left, _ in _kept(one, own, words))).decode("utf-8", "surrogatepass") for one, own in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], names=["row", "text"])

    out = small_batches(both).mapInArrow(lean(run), schema)
    return out.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


#: The same rows in DuckDB's SQL, for small tables.
ORACLE = r"""WITH cut AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM cut WHERE len(ws) >= 35)),
again AS (SELECT doc_id, i AS p FROM windows JOIN (SELECT w FROM windows GROUP BY 1 HAVING count(*) > 1) USING (w)),
every AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM cut),
told AS (SELECT e.doc_id, e.p, e.word, max(a.p) OVER (PARTITION BY e.doc_id ORDER BY e.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NULL AS kept FROM every e LEFT JOIN again a ON a.doc_id = e.doc_id AND a.p = e.p),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM told WHERE kept GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM cut LEFT JOIN left_over USING (doc_id)"""
