"""Documents whose sets of word shingles are alike, by signature trees.

Two documents link when the Jaccard similarity of their shingle sets is at least THRESHOLD (in hundredths, so that
the test is exact).  Documents with equal sets are one node.

Routing.  All tokens stand in one order, frequent ones last and else by hash.  The overlap of two sets that link is at
least THRESHOLD hundredths of either, so each shares a token of its prefix (the first n - ceil(0.8 n) + 1 of its
tokens) with the other's: nodes that share such a token stand in one list, and a pair without a common list cannot
link.  Lists with the same members are one.  What is frequent comes from counts over all documents; it goes to the
workers as a bitmap of fixed size, and decides how long lists get, never which pairs are found.

Trees.  Each list is a tree over signatures: its nodes hold the OR of their members' token bitmaps, whose width grows
with the set sizes, and the range of the sizes.  A dual traversal drops every pair of tree nodes whose largest possible
overlap cannot reach the threshold.  The pairs left join the nodes to roots, and only their spanning links come out;
a list of more than BLOCK members is taken as one root.  Under a root the nodes stand in blocks, by size classes of
which only neighbours can link; two blocks (or one with itself) are again traversed as trees, now with the sets at
hand, and every pair that is left at the leaves is compared set by set.  Each pair of nodes meets in one pair of
blocks, so every link is counted once; of a block pair's links only a node's count and one node that its links reach
come out, so what comes out is linear where the links are not.

Without words or text a document's set is empty and links with nothing.  Rows that share a doc_id count as one
document, and join the classes of all its texts; a null doc_id links with nothing.  A row's number of links is that
of other pairs of document and set whose sets link with its own, so a document of several sets counts once for each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import cut, dropped, free, give_back, lean, mix64, small_batches, stored
from lexloom.llm.links import components
from lexloom.llm.shingles import shingle_sets

THRESHOLD = 80
BLOCK, FAN = 512, 8
#: A block and the small roots that are dealt to a task together have about so many nodes and so many tokens at most.
DEALT, TOKENS = 2000, 1 << 19
#: Tokens that at least FREQUENT documents have stand last, about MARKED of them at most, in a bitmap of 2^MARKS bits.
FREQUENT, MARKED, MARKS = 32, 1 << 20, 24
#: Bits of a bitmap: a power of two, at least twice the set's size, between these.
LEAST_BITS, MOST_BITS = 512, 1 << 17


# ---------------------------------------------------------------- order of tokens, prefixes


def digests(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two numbers that stand for each set; 0 for an empty one."""
    out, full = np.zeros((2, len(sizes)), np.uint64), np.flatnonzero(sizes)
    if len(full):
        start = np.cumsum(sizes[full]) - sizes[full]
        out[0, full] = np.add.reduceat(mix64(flat, 21), start)
        out[1, full] = np.bitwise_xor.reduceat(mix64(flat, 22), start)
    return out.view(np.int64)


def _mark(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - MARKS)).astype(np.int64)


def frequent_marks(docs: DataFrame, portion: int = 2_000_000) -> np.ndarray:
    """A bitmap (raw, 2^MARKS bits) over hashes, with the most frequent tokens' bits set.

    Every portion of a task's tokens counts its repeated ones over distinct sets; the counts add up over all documents.
    """

    def count(batches):
        held, size = [], 0

        def repeated():
            seen, many = np.unique(np.concatenate(held), return_counts=True)
            often = many > 1
            return pa.RecordBatch.from_arrays([pa.array(seen[often].view(np.int64)), pa.array(many[often].astype(np.int64))], names=["token", "many"])

        for batch in batches:
            for flat, sizes in shingle_sets(batch.column(0).to_pylist()):
                # copies of one set count once a portion
                _, first = np.unique(digests(flat, sizes)[0], return_index=True)
                own = np.zeros(len(sizes), bool)
                own[first] = True
                held.append(flat[np.repeat(own, sizes)])
                size += len(held[-1])
                if size >= portion:
                    yield repeated()
                    held, size = [], 0
        if size:
            yield repeated()

    texts = small_batches(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")))
    many = texts.mapInArrow(lean(count), "token bigint, many bigint").groupBy("token").agg(F.sum("many").alias("many"))
    step = F.floor(F.log2(F.col("many")) * 8).cast("int")
    often = stored(many.where(F.col("many") >= FREQUENT).withColumn("step", step), "often")
    # from a histogram of a few hundred steps of frequency, as no task could rank them all: whole steps from the top,
    # and of the last one a share by hash
    steps = sorted(((r["step"], r["n"]) for r in often.groupBy("step").agg(F.count("*").alias("n")).collect()), reverse=True)
    left, least, share = MARKED, 1 << 20, 0.0
    for least, n in steps:
        share = min(1.0, left / n)
        left -= n
        if left <= 0:
            break
    part = F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < int(share * (1 << 20))
    top = often.where((F.col("step") > least) | ((F.col("step") == least) & part)).select("token").toPandas()
    dropped(often)
    bits = np.zeros(1 << MARKS, np.uint8)
    bits[_mark(top["token"].to_numpy(np.int64).view(np.uint64))] = 1
    return np.packbits(bits, bitorder="little")


def prefixes(flat: np.ndarray, sizes: np.ndarray, marks: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, numbers) of the sets' prefixes.  flat holds the sets one after the other, each sorted."""
    place = _mark(flat)
    late = (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    begin = np.cumsum(sizes) - sizes
    early = np.concatenate([[0], np.cumsum(~late)])
    own_early = early[begin + sizes] - early[begin]
    at = np.arange(len(flat)) - np.repeat(begin, sizes)
    before = early[:-1] - np.repeat(early[begin], sizes)
    rank = np.where(late, np.repeat(own_early, sizes) + at - before, before)
    need = np.where(sizes > 0, sizes - (threshold * sizes + 99) // 100 + 1, 0)
    return flat[rank < np.repeat(need, sizes)], need


# ---------------------------------------------------------------- bitmaps and trees


def width_of(size: int) -> int:
    """Bits of the bitmap of a set."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (2 * int(size) - 1).bit_length()))


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    """A row a set, in 64-bit words: a bit for each token modulo the width."""
    bits = np.zeros((len(sets), width // 64), np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (np.concatenate(sets) % np.uint64(width)).astype(np.int64)
    np.bitwise_or.at(bits, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return bits


def folded(raw: bytes, width: int) -> np.ndarray:
    """A bitmap at a narrower width: its parts OR-combined, as tokens modulo the narrower width set them."""
    return np.bitwise_or.reduce(np.frombuffer(raw, np.uint64).reshape(-1, width // 64), axis=0)


class Tree:
    """Levels of OR-combined bitmaps, size ranges and slack over sets in a given order; level 0 is the sets."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        # how many tokens of a set can stand behind bits that others of its tokens set as well
        slack = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, size, size, slack)]
        while len(bits) > 1:
            at = np.arange(0, len(bits), FAN)
            bits = np.bitwise_or.reduceat(bits, at, axis=0)
            _, low, high, slack = self.levels[-1]
            low, high, slack = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)
            self.levels.append((bits, low, high, slack))

    def raised(self, height: int) -> None:
        """Repeat the root up to a height, so that two trees have as many levels."""
        while len(self.levels) <= height:
            self.levels.append(self.levels[-1])


def _possible(a, b, i, j, threshold: int) -> np.ndarray:
    """Whether the largest overlap that members of tree nodes i and j can have may reach the threshold."""
    (bits_a, low_a, high_a, slack_a), (bits_b, low_b, high_b, slack_b) = a, b
    need = low_a[i] + low_b[j]
    most = np.minimum(high_a[i], high_b[j])
    out = (100 + threshold) * most >= threshold * need
    alive = np.flatnonzero(out)
    for part in np.array_split(alive, max(1, len(alive) * bits_a.shape[1] // 1_000_000)):
        both = np.bitwise_count(bits_a[i[part]] & bits_b[j[part]]).sum(axis=1).astype(np.int64)
        bound = np.minimum(most[part], both + np.minimum(slack_a[i[part]], slack_b[j[part]]))
        out[part] = (100 + threshold) * bound >= threshold * need[part]
    return out


def candidates(a: Tree, b: Tree, same: bool, threshold: int = THRESHOLD):
    """Pairs (i, j) of sets that the dual traversal cannot rule out; i < j where both trees are one."""
    height = max(len(a.levels), len(b.levels)) - 1
    a.raised(height)
    b.raised(height)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(height, -1, -1):
        keep = _possible(a.levels[level], b.levels[level], i, j, threshold)
        i, j = i[keep], j[keep]
        if level:
            child = np.arange(FAN)
            i, j = (x.ravel() for x in np.broadcast_arrays(i[:, None, None] * FAN + child[None, :, None], j[:, None, None] * FAN + child[None, None, :]))
            inside = (i < len(a.levels[level - 1][1])) & (j < len(b.levels[level - 1][1]))
            if same:
                inside &= i <= j
            i, j = i[inside], j[inside]
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def possible_pairs(size: np.ndarray, raw: list[bytes], threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list's members that their signatures cannot rule out.

    Sets that link differ in size by a fourth at most and so in width by one step: members of a width and of the next
    one, folded, make one tree.
    """
    width = np.array([8 * len(r) for r in raw], np.int64)
    found = []
    for w in np.unique(width):
        own = np.flatnonzero((width == w) | (width == 2 * w))
        if len(own) > 1 and (width[own] == w).any():
            own = own[np.argsort(size[own], kind="stable")]
            tree = Tree(np.stack([folded(raw[x], int(w)) for x in own]), size[own])
            i, j = candidates(tree, tree, True, threshold)
            found.append((own[i], own[j]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *(x[k] for x in found)]) for k in (0, 1))


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, portion: int = 1_000_000) -> np.ndarray:
    """How many tokens sets i[k] and j[k] share, for each k."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = place[: len(i)], place[len(i) :]
    sizes = np.array([len(sets[x]) for x in used], np.int64)
    start = np.cumsum(sizes) - sizes
    seen, code = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True)
    code, marked = code.astype(np.int32), np.zeros(len(seen), bool)
    del seen
    order = np.argsort(i, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        own = code[start[i[run[0]]] :][: sizes[i[run[0]]]]
        marked[own] = True
        for part in np.array_split(run, min(len(run), 1 + int(sizes[j[run]].sum()) // portion)):
            n = sizes[j[part]]
            first = np.cumsum(n) - n
            at = np.repeat(start[j[part]] - first, n) + np.arange(n.sum())
            out[part] = np.add.reduceat(marked[code[at]], first, dtype=np.int64)
        marked[own] = False
    return out


def linked(sets: list[np.ndarray], side: np.ndarray | None = None, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of sets (none empty) that link, each once; with side, only those between the two sides."""
    n = np.array([len(s) for s in sets], np.int64)
    if side is None:
        order = [np.lexsort(([int(s[0]) for s in sets], n))]
    else:
        order = [np.flatnonzero(side == x) for x in (0, 1)]
        if not len(order[0]) or not len(order[1]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = [o[np.argsort(n[o], kind="stable")] for o in order]
    width = width_of(n.max())
    trees = [Tree(bitmaps([sets[i] for i in o], width), n[o]) for o in order]
    i, j = candidates(trees[0], trees[-1], side is None, threshold)
    del trees
    i, j = order[0][i], order[-1][j]
    both = overlaps(sets, i, j)
    links = 100 * both >= threshold * (n[i] + n[j] - both)
    return i[links], j[links]


def _least(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of n nodes reaches by links (i, j)."""
    name = np.arange(n)
    while True:
        new, both = name.copy(), np.minimum(name[i], name[j])
        np.minimum.at(new, i, both)
        np.minimum.at(new, j, both)
        new = new[new]
        if (new == name).all():
            return name
        name = new


# ---------------------------------------------------------------- the join


def signatures(docs: DataFrame, marks: np.ndarray, key: str = "doc_id") -> DataFrame:
    """id, n, d1, d2 (a digest of the set), prefix, bits, a row a document; without shingles d1 and what follows are null."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # 2^MARKS bits
    names = ["id", "n", "d1", "d2", "prefix", "bits"]

    def run(batches):
        for batch in batches:
            ids, at = batch.column(0), 0
            for flat, sizes in shingle_sets(batch.column(1).to_pylist()):
                digest, empty, ends = digests(flat, sizes), sizes == 0, np.cumsum(sizes)
                tokens, many = prefixes(flat, sizes, shared.value)
                offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                bits = [None if n == 0 else bitmaps([flat[e - n : e]], width_of(n)).tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sizes)), pa.array(sizes), pa.array(digest[0], mask=empty), pa.array(digest[1], mask=empty), lists, pa.array(bits, pa.binary())], names=names)
                at += len(sizes)

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return small_batches(rows).mapInArrow(lean(run), "id bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>, bits binary")


def _spanning(batches):
    """Links (a, b) that span the pairs which the trees of lists leave.  A row a list: members (node, n, bits)."""
    for batch in batches:
        lists = batch.column(0)
        ends, members = lists.offsets.to_numpy(), lists.values
        node, size, raw = members.field("node").to_numpy(), members.field("n").to_numpy(), members.field("bits")
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            n = size[a:b]
            order = np.sort(n)
            if (5 * order[:-1] < 4 * order[1:]).all():
                continue  # no two sizes are near enough to link
            i, j = possible_pairs(n, raw.slice(a, b - a).to_pylist())
            if len(i):
                own = node[a:b]
                name = own[_least(i, j, b - a)]
                out.append(np.stack([own, name])[:, own != name])
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *out], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def root_links(nodes: DataFrame, block: int) -> DataFrame:
    """Links (a, b) whose components hold every pair of nodes that may link.  nodes: node, d1, n, prefix, bits."""
    # two hashes of its members stand for a list
    posted = nodes.select("node", "d1", F.explode("prefix").alias("token")).withColumns({"u": F.xxhash64("node", "d1"), "v": F.xxhash64("d1", "node")})
    lists = posted.groupBy("token").agg(F.count("*").alias("many"), F.bit_xor("u").alias("f"), F.bit_xor("v").alias("g")).where("many > 1")
    members = stored(posted.select("node", "d1", "token").join(lists, "token").select("many", "f", "g", "node", "d1").distinct(), "members")
    long = members.where(F.col("many") > block)
    stars = long.join(long.groupBy("f", "g").agg(F.min("node").alias("b")), ["f", "g"]).select(F.col("node").alias("a"), "b")
    short = members.where(F.col("many") <= block).join(nodes.select("node", "d1", "n", "bits"), ["node", "d1"])
    short = short.groupBy("f", "g").agg(F.collect_list(F.struct("node", "n", "bits")).alias("members")).select("members")
    return small_batches(short).mapInArrow(lean(_spanning), "a bigint, b bigint").unionByName(stars).where("a <> b").distinct()


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, own in pdf.groupby("root", sort=False):
        own = own.drop_duplicates(["node", "d1", "d2"])  # rows that repeat a doc_id and its set
        if len(own) > 1:
            sets = [np.frombuffer(s, np.uint64) for s in own["shingles"]]
            cross = int(own["i"].iloc[0]) != int(own["j"].iloc[0])
            side = (own["own"].to_numpy() != own["i"].to_numpy()).astype(np.int64) if cross else None
            i, j = linked(sets, side)
            copies, node, links = own["copies"].to_numpy(np.int64), own["node"].to_numpy(np.int64), np.zeros(len(own), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            found = np.flatnonzero(links)
            size = np.array([len(s) for s in sets], np.int64)
            out.append(pd.DataFrame({"d1": own["d1"].to_numpy()[found], "d2": own["d2"].to_numpy()[found], "n": size[found], "links": links[found], "a": node[found], "b": node[_least(i, j, len(own))[found]]}))
    if len(pdf) > BLOCK:
        give_back()
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("d1", "d2", "n", "links", "a", "b")})


def in_block_pairs(roots: DataFrame, block: int, tokens: int) -> DataFrame:
    """A row for each pair of blocks (i, j) that a node has a part in.  roots: root, node, d1, d2, n.

    A root beyond a block falls into size classes, by steps of a fourth, and each class into blocks; sets that link
    are in one class or in neighbouring ones, so only their blocks meet.
    """
    whole = roots.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"))
    small = (F.col("members") <= block) & (F.col("tokens") <= tokens)
    rows = roots.join(whole.select("root", small.alias("small")), "root")
    rows = rows.withColumn("class", F.when(F.col("small"), 0).otherwise(1 + F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("int")))
    sizes = rows.groupBy("root", "small", "class").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / tokens)).cast("int").alias("blocks"))
    sizes = sizes.withColumn("blocks", F.when(F.col("small"), 1).otherwise(F.col("blocks")))
    # a root has as many classes as sizes have steps
    next_to = Window.partitionBy("root").orderBy("class")
    beside = lambda f, step: F.when(f("class").over(next_to) == F.col("class") + step, f("blocks").over(next_to)).otherwise(0)
    sizes = sizes.withColumns({"lower": beside(F.lag, -1), "upper": beside(F.lead, 1)})
    rows = rows.join(sizes.drop("small"), ["root", "class"])
    name = lambda c, b: c.cast("long") * (1 << 32) + b
    rows = rows.withColumn("own", name(F.col("class"), F.pmod(F.xxhash64("node", "d1"), F.col("blocks"))))
    every = lambda many, step: F.when(F.col(many) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(many), F.lit(1)) - 1), lambda b: name(F.col("class") + step, b))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("other", F.explode(F.concat(every("blocks", 0), every("lower", -1), every("upper", 1))))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("root", "small", "node", "d1", "d2", "n", "own", "i", "j")


def classes(docs: DataFrame, key: str = "doc_id", block: int | None = None, tokens: int = TOKENS) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id, a row a document."""
    block = block or BLOCK
    signed = stored(signatures(docs, frequent_marks(docs), key), "signatures")
    whole = signed.where("n > 0 AND id IS NOT NULL")
    digest = ["d1", "d2", "n"]
    copies = whole.select("id", *digest).distinct().groupBy(*digest).agg(F.count("*").alias("copies"))
    nodes = whole.groupBy(*digest).agg(F.min("id").alias("node"), F.any_value("prefix").alias("prefix"), F.any_value("bits").alias("bits"))
    nodes = stored(nodes.join(copies, digest), "nodes")
    roots = cut(components(root_links(nodes, block)).withColumnRenamed("component", "root"))
    # the several sets of one name may share lists with no other name
    alone = nodes.groupBy("node").agg(F.count("*").alias("many")).where("many > 1").select("node", F.col("node").alias("root"))
    roots = roots.unionByName(alone.join(roots, "node", "left_anti"))
    placed = stored(roots.join(nodes.select("node", *digest, "copies"), "node"), "placed")
    total = placed.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    dealt = max(1, -(-total["nodes"] // DEALT), -(-total["tokens"] // tokens))
    pairs = in_block_pairs(placed, block, tokens)
    # the sets of these nodes alone
    texts = docs.select(F.col(key).cast("long").alias("node"), "text").where("node IS NOT NULL")
    # one plan at every size: the nodes under roots grow with the documents, so they are never broadcast
    items = texts.hint("merge").join(placed.select("node", "d1", "d2", "copies"), "node")
    names = ["node", "copies", "d1", "d2"]

    def to_sets(batches):
        for batch in batches:
            at = 0
            for flat, n in shingle_sets(batch.column(len(names)).to_pylist()):
                ends = np.cumsum(n)
                raw = pa.array([flat[e - m : e].tobytes() for e, m in zip(ends, n, strict=True)], pa.binary())
                own = pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(n)) for c in range(len(names))), raw], names=[*names, "shingles"])
                # of a doc_id with several texts, those whose set is the node's
                d1, d2 = digests(flat, n)
                yield own.filter(pa.array((n > 0) & (own.column(2).to_numpy() == d1) & (own.column(3).to_numpy() == d2)))
                at += len(n)

    items = items.select(*names, "text").mapInArrow(lean(to_sets), "node bigint, copies bigint, d1 bigint, d2 bigint, shingles binary")
    items = items.join(pairs.hint("merge"), ["node", "d1", "d2"])
    items = items.withColumns({"g": F.when(F.col("small"), F.pmod(F.xxhash64("root"), F.lit(dealt)).cast("int")).otherwise(-1), "r": F.when(~F.col("small"), F.col("root")).otherwise(-1)})
    items = items.select("g", "r", "i", "j", "node", "root", "own", "copies", "d1", "d2", "shingles")
    found = cut(items.groupBy("g", "r", "i", "j").applyInPandas(_compare, "d1 bigint, d2 bigint, n bigint, links bigint, a bigint, b bigint"))
    # documents of several sets join the classes of all of them
    several = whole.groupBy("id").agg(F.min(F.struct(*digest)).alias("least"), F.max(F.struct(*digest)).alias("most")).where("least <> most").select("id")
    several = whole.select("id", *digest).join(several, "id", "left_semi").join(nodes.select(*digest, "node"), digest).select(F.col("id").alias("a"), F.col("node").alias("b"))
    named = components(found.select("a", "b").unionByName(several))
    counted = nodes.select(*digest, "node", "copies").join(found.groupBy(*digest).agg(F.sum("links").alias("links")), digest, "left")
    out = signed.select("id", *digest).join(counted, digest, "left").join(named, "node", "left")
    n_links = F.when(F.col("id").isNull() | F.col("node").isNull(), F.lit(0).cast("long")).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    out = out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), n_links.alias("n_links"), component.alias("component_id"))
    out = stored(out, "classes")
    dropped(signed, nodes, roots, placed, found)
    return out


def one_of_each_class(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the documents that link to one with a smaller doc_id, and one row of those that share a doc_id.

    Rows with a null doc_id all stay.
    """
    kept = classes(docs, key).where(F.col(key) == F.col("component_id")).select(key).distinct()
    first = Window.partitionBy(key).orderBy(F.xxhash64("text"))
    n = free(docs.columns, "n")
    named = docs.where(F.col(key).isNotNull()).join(kept, key, "left_semi").withColumn(n, F.row_number().over(first)).where(F.col(n) == 1)
    return named.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
