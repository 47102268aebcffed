"""Repeated passages, repaired conversations and ranked search against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.llm import conversation_repair, repeated_passages, threshold_search

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- 11: repeated passages


def brute_passages(texts, size):
    """Words that stay of each text."""
    split = [WORD.findall(t or "") for t in texts]
    starts = Counter(tuple(ws[i : i + size]) for ws in split for i in range(len(ws) - size + 1))
    out = []
    for ws in split:
        gone = {j for i in range(len(ws) - size + 1) if starts[tuple(ws[i : i + size])] > 1 for j in range(i, i + size)}
        out.append([w for i, w in enumerate(ws) if i not in gone])
    return split, out


def passage_texts(seed, n=60, size=12):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4)
    shared = [[word() for _ in range(rng.randrange(size - 2, 4 * size))] for _ in range(5)]
    texts = []
    for _ in range(n):
        own = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at, passage = rng.randrange(len(own) + 1), list(rng.choice(shared))
            if rng.random() < 0.4:
                passage[rng.randrange(len(passage))] = "edited"
            own[at:at] = passage
        texts.append(rng.choice([" ", "\n", "  \t"]).join(own))
    return [*texts, texts[0], texts[0], " ".join(["same"] * 80), " ".join(["ab", "cd"] * 50), None, "", " \n", "x" * 5000]


@pytest.mark.parametrize(("group", "lot"), [(1024, 400_000), (3, 400_000), (20, 50)])
def test_passages_equal_brute_force(spark, monkeypatch, group, lot):
    monkeypatch.setattr(repeated_passages, "GROUP", group)  # small groups are prefixes that grow to a whole window
    monkeypatch.setattr(repeated_passages, "LOT_WORDS", lot)
    texts = passage_texts(group)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    split, left = brute_passages(texts, 12)
    want = {i: (len(s), len(s) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, (s, k) in enumerate(zip(split, left, strict=True))}
    assert {r[0]: tuple(r[1:]) for r in repeated_passages.repeated_digest(df, 12).collect()} == want
    kept = {r["doc_id"]: r["text"] for r in repeated_passages.without_repeats(df, 12).collect()}
    assert kept == {i: " ".join(k) if len(k) < len(s) else t for i, (t, s, k) in enumerate(zip(texts, split, left, strict=True))}


def test_passages_of_odd_tables(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, passage, None, "a", 1), (1, passage, None, "a", 1), (None, f"x {passage} y", "en", None, None), (None, None, "en", "a", 0), (5, "", "en", "a", 0), (6, "short text", "en", "a", 0), (7, "😀\x00 " + "long " * 34, "en", "a", 0)]
    clash = ["k", "g", "r", "s", "many", "marks", "row", "key", "run", "bits", "n"]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in clash})
    got = repeated_passages.without_repeats(df)
    assert got.columns == df.columns and got.schema["k"].dataType == df.schema["k"].dataType
    kept = got.collect()
    assert all(r[c] == c for r in kept for c in clash)
    assert sorted((r["text"] or "", r["doc_id"] or 0) for r in kept) == sorted([("", 1), ("", 1), ("x y", 0), ("", 0), ("", 5), ("short text", 6), (rows[-1][1], 7)])
    none = spark.createDataFrame([], DOCS)
    assert repeated_passages.repeated_digest(none).count() == 0 and repeated_passages.without_repeats(none).count() == 0


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    texts = [t for t in passage_texts(9) if t]
    whole = repeated_passages.runs_of(texts, 12)
    monkeypatch.setattr(repeated_passages, "PIECE", 40)
    assert all(np.array_equal(a, b) for a, b in zip(whole, repeated_passages.runs_of(texts, 12), strict=True))
    assert [w for p in repeated_passages.pieces_of(texts[0]) for w in p.split()] == texts[0].encode().split()


def test_nodes_are_the_repeats():
    """Every node that is deep enough: the passages that stand more than once and cannot go on to the right."""
    rng = random.Random(4)
    for _ in range(30):
        words = [rng.choice("abc") for _ in range(60)]
        ids = np.array([ord(w) for w in words] + [-1])
        order, shared = repeated_passages.suffix_tree(ids, 40)
        assert [words[i:] for i in order if i < 60] == sorted(words[i:] for i in range(60))
        got = {(depth, frozenset(leaves.tolist())) for depth, leaves in repeated_passages.deep_nodes(order, shared, 3)}
        places = defaultdict(set)
        for a, b in itertools.combinations(range(60), 2):
            n = next((i for i in range(60 - b) if words[a + i] != words[b + i]), 60 - b)
            if n >= 3:
                places[tuple(words[a : a + n])] |= {a, b}
        assert got == {(len(p), frozenset(i for i in range(60) if tuple(words[i : i + len(p)]) == p)) for p in places}


# ---------------------------------------------------------------- 12: conversations

BLANKS = " \t\n\x0b\x0c\r"
PATTERN = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [] if code == 0 else [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """(cost, audit, lines) by trying all edits with up to two inserts in a gap."""
    faults, best = faults_of(rows), None
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    choices = []
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        extra = 5 if fault == "truncated" else 0
        own = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            own += [(extra, "K", [(role, text)]), (1 + extra, "R", [("user", text)]), (1 + extra, "R", [("assistant", text)])]
        choices += [[(5 * len(g), "I" * len(g), [(r, "") for r in g]) for g in gaps], own]
    choices.append(choices[0] if choices else [(0, "", [])])
    for picked in itertools.product(*choices):
        left = [x for _, _, rows_left in picked for x in rows_left]
        if PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in left)):
            one = (sum(c for c, _, _ in picked), "".join(a for _, a, _ in picked), [f"{r}:{t}" for r, t in left])
            best = one if best is None or one[:2] < best[:2] else best
    return best


def viterbi_repair(rows):
    """The same for long conversations, state by state."""
    best = {"": (0, "", [])}

    def put(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def with_inserts(table):
        out = dict(table)
        for _ in range(2):
            for state, (cost, audit, lines) in list(out.items()):
                role = "assistant" if state == "u" else "user"
                put(out, role[0], (cost + 5, audit + "I", [*lines, role + ":"]))
        return out

    for (_, _, role, text), fault in zip(rows, faults_of(rows), strict=True):
        new = {}
        for state, (cost, audit, lines) in with_inserts(best).items():
            put(new, state, (cost + 2, audit + "D", lines))
            for price, letter, to in [] if fault in ("blank", "duplicate") else [(0, "K", role), (1, "R", "user"), (1, "R", "assistant")]:
                if to[:1] and state + to[0] in ("s", "u", "su", "au", "ua"):
                    put(new, to[0], (cost + price + 5 * (fault == "truncated"), audit + letter, [*lines, f"{to}:{text}"]))
        best = new
    ends = with_inserts(best)
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda x: x[:2])


def want_row(rows, repair):
    turns = [t for _, t, _, _ in rows if t is not None]
    cost, audit, lines = repair(rows)
    faults = Counter(faults_of(rows))
    pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_turns(rng, conv, n, nulls=True):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None if nulls else "user"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Yes.", "It is so. \n", None if nulls else "Well.", "s a i d."]
    out = [(conv, i if rng.random() < 0.8 else i + 1000 * rng.randrange(3), rng.choice(roles), rng.choice(texts)) for i in range(n)]
    return list({(c, t): (c, t, r, x) for c, t, r, x in out}.values())


def test_conversations_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [r for c in range(400) for r in random_turns(rng, c, rng.randrange(1, 5))] + [(None, 0, "user", "No id."), (None, 1, "assistant", "None."), (900, None, "user", "Hm."), (901, 5, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "seg", "at", "kind", "fault", "copy", "audit")}).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.repair_digest(table).collect()}
    left = defaultdict(list)
    for r in damage(rows):
        left[r[0]].append(r)
    want = {c: want_row(sorted(left[c], key=lambda r: (r[1] is not None, r[1] or 0)), brute_repair) for c in {r[0] for r in rows}}
    assert any(not left[c] for c in want) and got == want


def test_repair_by_states_is_the_brute_one():
    rng = random.Random(5)
    for _ in range(200):
        rows = damage(random_turns(rng, rng.randrange(10**6), 4))[:4]
        assert viterbi_repair(rows) == brute_repair(rows)


def test_long_conversations_over_many_partitions(spark):
    """A conversation with most of the rows: matrices of its range partitions meet in a tree."""
    rng = random.Random(8)
    rows = [r for c, n in ((1, 3000), (2, 1), (3, 700), (4, 8)) for r in random_turns(rng, c, n, nulls=False)]
    rows = [(c, t, r, x if x in ("", " \t", "cut off") or rng.random() < 0.2 else f"{x[:-1]} {t}{x[-1]}") for c, t, r, x in rows]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        repair = conversation_repair.Repair(conversation_repair.damaged(table))
        assert repair.resolved.where("conv = 1").count() > 3
        got = {r["conv_id"]: tuple(r)[1:] for r in conversation_repair.repair_digest(table).collect()}
        kept = defaultdict(list)
        for r in sorted(repair.repaired().collect(), key=lambda r: (r["conv_id"], r["position"])):
            kept[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    left = defaultdict(list)
    for r in damage(rows):
        left[r[0]].append(r)
    for c in (1, 2, 3, 4):
        ordered = sorted(left[c], key=lambda r: r[1])
        assert got[c] == want_row(ordered, viterbi_repair)
        assert kept[c] == viterbi_repair(ordered)[2]


def test_products_are_associative():
    rng = random.Random(2)
    for _ in range(100):
        a, b, c = (conversation_repair.product("".join(rng.choice(conversation_repair.LETTERS) for _ in range(rng.randrange(1, 5)))) for _ in range(3))
        assert conversation_repair.times(conversation_repair.times(a, b), c) == conversation_repair.times(a, conversation_repair.times(b, c))


def test_no_conversations(spark):
    assert conversation_repair.repair_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---------------------------------------------------------------- 13: ranked search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=20):
    """(item, rank, doc, score) of rows (doc_id, text)."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        query, scored = Counter(terms(text)), []
        for d, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in query.items() if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out += [(item, r + 1, d if there else None, -s) for r, (s, there, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    words = ["The", "the", "harbour", "Größe", "naïve", "x1", "日本", "42", "lamp", "shore", "rope", "İ", "a_b", "c-d"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(300)] + [(300, None), (301, ""), (302, "...!"), (None, "harbour lamp"), (None, "harbour lamp"), (303, "harbour lamp"), (304, "harbour lamp"), (304, "harbour lamp"), (305, text(20_000))]
    items = [(i, text(rng.randrange(1, 30))) for i in range(30)] + [(50, None), (51, "unknownword"), (52, "..."), (None, "rope"), (53, "lamp lamp harbour")]
    queries = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "keys", "terms", "score", "rank", "number", "id")}).repartition(3)
    monkeypatch.setattr(threshold_search, "SHARD_POSTINGS", 400)
    monkeypatch.setattr(threshold_search, "BLOCK_QUERIES", 20)
    got = threshold_search.rank_documents(table, queries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items)
    none = table.limit(0)
    assert threshold_search.rank_documents(none, queries).count() == 0
    assert threshold_search.rank_documents(table, queries.limit(0)).count() == 0


def test_a_shard_is_a_row_group(spark, tmp_path, monkeypatch):
    """Readers hold a row group, so its size must not grow with the shards that a task writes."""
    monkeypatch.setattr(threshold_search, "SHARD_POSTINGS", 10)
    docs = spark.createDataFrame([(i, f"harbour lamp w{i}") for i in range(60)], "doc_id long, text string").coalesce(1)
    threshold_search.build_index(docs, str(tmp_path / "lists"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "lists/shards").glob("*.parquet")]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert len(groups) == 15 and set(groups) == {1}


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(1)
    for n in (0, 1, 30, 20_000):
        impacts = [np.where(rng.random(n) < p, (1000 / (1 + 200 * rng.random(n))).astype(np.int64), 0) for p in (0.9, 0.3, 0.05)]
        weights = [1, 40, 300]
        lists = []
        for x in impacts:
            own = np.lexsort((np.arange(n), -x))
            own = own[x[own] > 0]
            lists.append((own, x[own]))
        whole = sum(w * x for w, x in zip(weights, impacts, strict=True)) if n else np.zeros(0, np.int64)
        asked = []

        def score(docs, asked=asked, whole=whole):
            asked.append(len(docs))
            return whole[docs]

        docs, scores = threshold_search.threshold_best(lists, weights, score, n, 10)
        want = [d for d in np.lexsort((np.arange(n), -whole))[:10] if whole[d] > 0]
        assert docs.tolist() == want and scores.tolist() == [int(whole[d]) for d in want]
        assert n < 1000 or sum(asked) < n / 2


def test_long_texts_count_in_pieces(monkeypatch):
    text = "Ab cd-ef 9Z " * 500
    whole = threshold_search.term_counts(text)
    monkeypatch.setattr(threshold_search, "PIECE", 17)
    assert threshold_search.term_counts(text) == whole == Counter(t.encode() for t in terms(text))
