"""Personal data in texts, with DataFrame functions only.

Four kinds follow fixed patterns (BASE): e-mail and IP addresses, card numbers, telephone numbers; matches that fail a
kind's test are dropped.  Further spans come from weak supervision, for each kind of ADDED by itself: secrets (keys,
tokens, passwords) and numbers that identify a person.  A loose pattern proposes candidates that no span before them
touches; regex, gazetteer and context labelers vote 1, -1 or 0 (no opinion) on each; expectation-maximisation over
the counts of vote patterns estimates the share of true ones and how reliable each labeler is; the posteriors train a
logistic classifier, which decides.  It does not see the votes but features of the span and what stands before it
(length, digits, case, marks, variety, name), so it also says something where the labelers are silent.  The driver
gets a row for each distinct vote pattern and for each distinct combination of features, both bounded.

Not searched for: names and postal addresses, secrets of under four characters, and those that stand neither behind a
name of the gazetteer nor hold a digit.

Positions count code points, the end is exclusive.  Patterns are written so that they never back-track or recurse over
a long run of characters, and work is linear in text and matches.  Null texts count as empty and have no spans.  Rows
that repeat are rows of their own.  Without any candidate nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import dropped, free, stored

#: Kinds in the order that breaks ties.  The patterns match what the plain ones match:
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+       ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card [0-9]([\x20-]?[0-9])+                                    phone \+[0-9][\x20().0-9-]+[0-9]
#: but take possessive runs, and start a run only at its beginning or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "phone": "+"}
ADDED = ("secret", "id")
ORDER = {kind: i for i, kind in enumerate([*BASE, *ADDED])}

#: Names of what should stay secret.
GAZETTEER = ["password", "passwd", "pwd", "passphrase", "token", "secret", "apikey", "api_key", "access_key", "secret_key", "auth", "credential"]
#: Words before a number that identifies a person.
ID_WORDS = ["ssn", "social", "security", "passport", "national", "identity", "id", "tax", "insurance", "licence", "license"]
#: A name with = or :, and what a run without a name is made of; full stops only inside.
NAME = r"""(?:[A-Za-z_]{2,32} ?[=:] ?["']?)"""
RUN = r"(?=[A-Za-z0-9_/+.-]{12})[A-Za-z0-9_/+-]++(?:\.[A-Za-z0-9_/+-]++)*+"
VALUE = r"""(?=[^\s"'<>,;]{4})[^\s"'<>,;.)]++(?:[.)]++[^\s"'<>,;.)]++)*+"""
#: What an added kind's candidates look like.  A secret: a name of the gazetteer and anything of four characters or
#: more, or at most a name and a run of twelve or more characters that holds a digit or is a key id.  A number that
#: identifies a person: nine digits in three groups, none of which is all zeros (nor the first 666 or above 899, which
#: are never given out), and up to two words before it.
START = r"(?<![A-Za-z0-9_/+.@-])"
CANDIDATES = {
    "secret": rf"""{START}(?:(?=[A-Za-z_]++ ?[=:])(?i:[A-Za-z_]{{0,12}}(?:{"|".join(GAZETTEER)})s?) ?[=:] ?["']?{VALUE}|{NAME}?+(?=[A-Za-z_/+.-]*+[0-9]|AKIA[A-Z]{{16}}){RUN}(?![A-Za-z0-9@]))""",
    "id": rf"{START}(?:[A-Za-z]{{2,12}}[ :#.]{{1,2}}){{0,2}}+(?!000|666|9)[0-9]{{3}}([ -])(?!00)[0-9]{{2}}\1(?!0000)[0-9]{{4}}(?![0-9A-Za-z@-])",
}
LEADS = {"secret": f"^{NAME}", "id": "^(?:[A-Za-z]{2,12}[ :#.]{1,2}){0,2}"}
#: What a text with a candidate has.
POSSIBLE = {"secret": "[0-9]|AKIA|[A-Za-z_] ?[=:]", "id": "[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}"}
#: Matches are worked through in runs of this many, so that no array grows one by one over all of them.
STRETCH = 128


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        second = F.when((F.length(digits) - i) % 2 == 1, d * 2).otherwise(d)
        return total + F.when(second > 9, second - 9).otherwise(second)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _fits(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255")
        return F.forall(F.split(match, r"\."), lambda p: small(F.regexp_replace(p, "^0+(?=[0-9])", "")))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def let(value: Column, f) -> Column:
    """f(value), with value bound to a variable, so that it is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(items: Column, size, joined=lambda a, b: a + b) -> Column:
    """For each item the sum (or what else `joined` makes of two numbers) of the sizes of those before it.

    Linear in the number of items: stretches of items are summed up first; only inside a stretch, and over the
    stretches' sums, arrays grow.
    """
    nothing = F.lit([]).cast("array<bigint>")

    def sums(array, of):
        begin = F.struct(F.lit(0).cast("long").alias("sum"), nothing.alias("out"))
        step = lambda acc, x: F.struct(joined(acc["sum"], of(x)).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(array, begin, step, lambda acc: acc["out"])

    total = lambda stretch: F.aggregate(stretch, F.lit(0).cast("long"), lambda a, x: joined(a, size(x)))

    def by_stretches(own):
        starts = F.sequence(F.lit(1), F.size(own), F.lit(STRETCH))
        return let(F.transform(starts, lambda i: F.slice(own, i, STRETCH)), lambda stretches: let(sums(stretches, total), lambda before: F.flatten(F.zip_with(stretches, before, lambda x, b: F.transform(sums(x, size), lambda y: joined(y, b))))))

    return F.when(F.size(items) == 0, nothing).when(F.size(items) <= STRETCH, sums(items, size)).otherwise(by_stretches(items))


def _matches(text: Column, pattern: str) -> Column:
    """(m, at) of each match: the matched string and where it begins.

    Splitting at the pattern gives what lies between the same matches, so their lengths add up to the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(steps):
        before = running(steps, lambda x: x["gap"] + F.length(x["m"]))
        return F.zip_with(steps, before, lambda x, b: F.struct(x["m"].alias("m"), (b + x["gap"]).alias("at")))

    return let(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).cast("long").alias("gap"))), lambda steps: let(F.filter(steps, lambda x: x["m"].isNotNull()), placed))


SPAN = "struct<at:bigint,rank:int,kind:string,upto:bigint>"


def _span(kind: str, at: Column, upto: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), F.lit(ORDER[kind]).alias("rank"), F.lit(kind).alias("kind"), upto.cast("long").alias("upto"))


def _base(text: Column) -> Column:
    """Sorted spans of the fixed kinds.  Texts without a digit or an @ aren't searched for what needs one."""
    parts = []
    for kind, pattern in BASE.items():
        kept = F.filter(_matches(text, pattern), lambda x: _fits(kind, x["m"]))  # noqa: B023
        spans = F.transform(kept, lambda x: _span(kind, x["at"], x["at"] + F.length(x["m"])))  # noqa: B023
        needed = F.contains(text, F.lit(GUARDS[kind])) if kind in GUARDS else text.rlike("[0-9]{2}|[0-9][\\x20.-][0-9]")
        parts.append(F.when(needed, spans).otherwise(F.lit([]).cast(f"array<{SPAN}>")))
    return F.sort_array(F.concat(*parts))


def _apart(spans: Column, found: Column) -> Column:
    """Those of found (at, upto, ...) that no span touches.

    Beyond a stretch of spans, which stand in order, a candidate halves them until it knows how many begin before its
    end, and looks up how far the farthest of those reaches.
    """

    def by_halves(starts):
        last = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("upto"))
        reach = running(F.concat(F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["upto"].alias("upto"))), F.array(last)), lambda s: s["upto"], F.greatest)
        half = lambda r: ((r["low"] + r["high"]) / 2).cast("int")

        def before(end):
            begin = F.struct(F.lit(0).alias("low"), F.size(starts).alias("high"))
            lower = lambda r: F.struct(r["low"].alias("low"), half(r).alias("high"))
            upper = lambda r: F.struct((half(r) + 1).alias("low"), r["high"].alias("high"))
            step = lambda r, _: F.when(r["low"] >= r["high"], r).when(F.element_at(starts, half(r) + 1) < end, upper(r)).otherwise(lower(r))
            return F.aggregate(F.sequence(F.lit(1), F.lit(32)), begin, step, lambda r: r["low"])

        return let(reach, lambda far: F.filter(found, lambda c: F.element_at(far, before(c["upto"]) + 1) <= c["at"]))

    one_by_one = F.filter(found, lambda c: ~F.exists(spans, lambda s: (s["at"] < c["upto"]) & (c["at"] < s["upto"])))
    return F.when((F.size(spans) <= STRETCH) | (F.size(found) == 0), one_by_one).otherwise(let(F.transform(spans, lambda s: s["at"]), by_halves))


def _candidates(kind: str, text: Column, taken: Column) -> Column:
    """(votes, features, at, upto) of each candidate of an added kind that no span in `taken` touches."""
    lead = lambda x: F.regexp_extract(x["m"], LEADS[kind], 0)
    named = F.transform(_matches(text, CANDIDATES[kind]), lambda x: F.struct(x["m"].alias("m"), x["at"].alias("at"), lead(x).alias("name")))
    value = lambda x: F.substring(x["m"], F.length(x["name"]) + 1, F.length(x["m"]))
    parts = F.transform(named, lambda x: F.struct(x["name"].alias("name"), value(x).alias("value"), (x["at"] + F.length(x["name"])).alias("at"), (x["at"] + F.length(x["m"])).alias("upto")))
    apart = let(F.filter(parts, lambda c: F.length(c["value"]) > 0), lambda own: _apart(taken, own))
    vote = _secret_votes if kind == "secret" else _id_votes
    found = F.transform(apart, lambda c: F.struct(_code(vote(c["name"], c["value"]), 3).alias("votes"), _code(_features(c["name"], c["value"]), BASE_OF_FEATURES).alias("features"), c["at"].alias("at"), c["upto"].alias("upto")))
    return F.when(text.rlike(POSSIBLE[kind]), found).otherwise(F.lit([]).cast("array<struct<votes:int,features:int,at:bigint,upto:bigint>>"))


def _code(digits: list[Column], base: int) -> Column:
    """Small numbers as one, in a base; votes count from 0."""
    out = F.lit(0)
    for i, d in enumerate(digits):
        out = out + (d + 1 if base == 3 else d) * base**i
    return out.cast("int")


def digits_of(code: int, base: int, many: int) -> tuple:
    return tuple(code // base**i % base - (base == 3) for i in range(many))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def _word(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, "^[A-Za-z_]+", 0))


def _known(name: Column) -> Column:
    return F.rlike(_word(name), F.lit("(?:" + "|".join(GAZETTEER) + ")s?$"))


def _secret_votes(name: Column, value: Column) -> list[Column]:
    """1: a secret, -1: none, 0: no opinion."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", "")) / F.length(value)
    marked = value.rlike("[/_.-]")
    return [
        _vote(value.rlike("^[A-Z]{4}[0-9A-Z]{16}$")),  # regex: key id of a cloud service
        _vote(value.rlike("^[0-9a-f]{16,}$") & value.rlike("[a-f]")),  # regex: hexadecimal
        _vote(value.rlike(r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.")),  # regex: signed token
        _vote(_known(name), name != ""),  # gazetteer of names
        _vote(F.contains(name, F.lit("=")) | name.rlike("[\"']$")),  # context: assigned or quoted
        _vote(digits.between(0.1, 0.9) & ~marked, (digits == 1) | marked),  # a mixture of letters and digits, without marks
        _vote(F.length(value) >= 18, F.length(value) < 14),
        _vote(F.lit(False), value.rlike(r"^[A-Za-z]+(?:[/_.-][A-Za-z]+)*$|^[0-9/_.:+-]+$")),  # words, dates and numbers
    ]


def _id_votes(name: Column, value: Column) -> list[Column]:
    """1: a number that identifies a person, -1: none, 0: no opinion."""
    words = F.lower(name)
    return [
        _vote(F.rlike(words, F.lit(r"\b(?:" + "|".join(ID_WORDS) + r")\b"))),  # gazetteer of words before it
        _vote(F.contains(value, F.lit("-")), F.contains(value, F.lit(" "))),  # regex: the usual writing
        _vote(name.rlike("[:#]"), name == ""),  # context: announced
    ]


LABELERS = {"secret": 8, "id": 3}
#: Of each feature the number of values; all are below BASE_OF_FEATURES.
FEATURES, BASE_OF_FEATURES = (5, 5, 4, 4, 2, 3, 2), 5


def _features(name: Column, value: Column) -> list[Column]:
    """Length, share of digits, case, marks, variety of characters, what name stands before it, and how."""
    size = F.length(value)
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    lower, upper = value.rlike("[a-z]"), value.rlike("[A-Z]")
    steps = lambda x, at: sum(((x >= a).cast("int") for a in at), F.lit(0))
    return [
        steps(size, (8, 14, 24, 48)),
        F.when(digits == 0, 0).when(digits == size, 4).otherwise(1 + steps(digits / size, (0.2, 0.6))),
        F.when(lower & upper, 3).when(upper, 2).when(lower, 1).otherwise(0),
        F.when(F.contains(value, F.lit("/")), 3).when(F.contains(value, F.lit(".")), 2).when(value.rlike("[_+-]"), 1).otherwise(0),
        (F.size(F.array_distinct(F.split(F.substring(value, 1, 64), ""))) * 2 >= F.least(size, F.lit(32))).cast("int"),
        F.when(_known(name), 2).when(name != "", 1).otherwise(0),
        (F.contains(name, F.lit("=")) | name.rlike("[\"'#:]\\s?$")).cast("int"),
    ]


# ---------------------------------------------------------------- reliabilities and classifier


def estimate(patterns: dict[tuple, int], rounds: int = 200) -> dict[tuple, float]:
    """Posterior of each vote pattern by expectation-maximisation of a two-class model with independent labelers.

    No opinion is no evidence.  The share of true candidates is estimated like the labelers' rates; a prior that holds
    each labeler right four times in five weighs as much as a tenth of the candidates (ten at least), so that the
    classes keep their meaning where one is all but empty.
    """
    total = sum(patterns.values())
    weight = max(10.0, total / 10)
    post = {v: min(0.9, max(0.1, 0.5 + 0.2 * sum(v))) for v in patterns}
    for _ in range(rounds):
        share = (sum(n * post[v] for v, n in patterns.items()) + 1) / (total + 2)
        rate = [[{s: weight * (0.8 if c == (s > 0) else 0.2) for s in (-1, 1)} for _ in next(iter(patterns))] for c in (False, True)]
        for v, n in patterns.items():
            for c in (0, 1):
                for i, x in enumerate(v):
                    if x:
                        rate[c][i][x] += n * (post[v] if c else 1 - post[v])
        for v in post:
            log = [math.log(share if c else 1 - share) + sum(math.log(rate[c][i][x] / sum(rate[c][i].values())) for i, x in enumerate(v) if x) for c in (0, 1)]
            post[v] = 1 / (1 + math.exp(max(-500.0, min(500.0, log[0] - log[1]))))
    # what no labeler speaks for is none
    return {v: p if max(v) > 0 else min(p, 0.1) for v, p in post.items()}


def train(rows: list[tuple[tuple, int, float]], rounds: int = 500, step: float = 2.0, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier, the bias first and then one for each value of each feature.

    rows: features, how many candidates have them, and the mean of their posteriors.
    """
    first = [1 + sum(FEATURES[:i]) for i in range(len(FEATURES))]
    places = [[0] + [a + x for a, x in zip(first, f, strict=True)] for f, _, _ in rows]
    total, w = sum(math.sqrt(n) for _, n, _ in rows), [0.0] * (1 + sum(FEATURES))
    for _ in range(rounds):
        slope = [decay * x for x in w]
        for own, (_, n, p) in zip(places, rows, strict=True):
            gap = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w[i] for i in own))))) - p
            for i in own:
                slope[i] += math.sqrt(n) / total * gap
        w = [a - step * b for a, b in zip(w, slope, strict=True)]
    return w


def _votes_counted(docs: DataFrame, text: str) -> DataFrame:
    """kind, votes, features, n: how many candidates of all documents have each."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where(F.col("t").rlike("|".join(POSSIBLE.values()))).withColumn("base", _base(F.col("t")))
    found = F.concat(*[F.transform(_candidates(kind, F.col("t"), F.col("base")), lambda c: F.struct(F.lit(kind).alias("kind"), c["votes"].alias("votes"), c["features"].alias("features"))) for kind in ADDED])  # noqa: B023
    return rows.select(F.explode(found).alias("c")).select("c.*").groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text: str = "text") -> dict[str, list[float]]:
    """Weights of each added kind's classifier, from all candidates of docs; a kind without any is missing."""
    counted = stored(_votes_counted(docs, text), "votes")
    out = {}
    # at most three to the number of labelers rows a kind
    votes = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    for kind in ADDED:
        patterns = {digits_of(r["votes"], 3, LABELERS[kind]): r["n"] for r in sorted(votes, key=lambda r: r["votes"]) if r["kind"] == kind}
        if not patterns:
            continue
        post = [(sum((x + 1) * 3**i for i, x in enumerate(v)), p) for v, p in estimate(patterns).items()]
        known = docs.sparkSession.createDataFrame(post, "votes int, p double")
        means = counted.where(F.col("kind") == kind).join(F.broadcast(known), "votes").groupBy("features").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("p"))
        # at most as many rows as there are combinations of features
        out[kind] = train([(digits_of(r["features"], BASE_OF_FEATURES, len(FEATURES)), r["n"], r["p"]) for r in means.orderBy("features").collect()])
    dropped(counted)
    return out


def _accepted(features: Column, weights: list[float]) -> Column:
    logit, at = F.lit(weights[0]), 1
    for i, many in enumerate(FEATURES):
        own = F.pmod(F.floor(features / BASE_OF_FEATURES**i), F.lit(BASE_OF_FEATURES))
        logit = logit + F.element_at(F.array(*[F.lit(w) for w in weights[at : at + many]]), own.cast("int") + 1)
        at += many
    return logit > 0


def with_spans(docs: DataFrame, weights: dict[str, list[float]], text: str = "text", to: tuple = ("base", "spans")) -> DataFrame:
    """docs with two new columns: sorted arrays of (at, rank, kind, upto), of the fixed kinds and of all kinds."""
    t, (base, spans) = F.coalesce(F.col(text), F.lit("")), to
    docs = docs.withColumn(base, _base(t)).withColumn(spans, F.col(base))
    for kind, own in weights.items():
        found = F.transform(F.filter(_candidates(kind, t, F.col(spans)), lambda c: _accepted(c["features"], own)), lambda c: _span(kind, c["at"], c["upto"]))  # noqa: B023
        docs = docs.withColumn(spans, F.sort_array(F.concat(spans, found)))
    return docs


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["upto"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_secret, n_id."""
    rows = with_spans(docs.select(key, "text"), fit(docs))
    many = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed_base, listed_all = listed(F.col("base")), listed(F.col("spans"))
    return rows.select(key, *[many("base", k) for k in BASE], F.sha2(listed_base, 256).alias("base_sha256"), listed_all.alias("spans"), F.size("spans").cast("long").alias("n_spans"), *[many("spans", k) for k in ADDED])


def _redacted(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by the kind of its first in brackets.

    Spans are worked through in stretches; a stretch's text is cut out once, and its spans are cut out of that.
    """
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit([]).cast("array<string>").alias("out"))
    piece = lambda t, a, b: F.substring(t, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int"))

    def stretch(acc, own):
        """Append one string for a stretch of spans: what follows the last span's end, up to the stretch's end."""
        low = acc["at"]
        high = F.greatest(low, F.array_max(F.transform(own, lambda s: s["upto"])))

        def inside(t):
            start = F.struct(low.alias("at"), F.lit("").alias("out"))
            step = lambda a, s: F.when(s["at"] >= a["at"], F.struct(F.greatest(a["at"], s["upto"]).alias("at"), F.concat(a["out"], piece(t, a["at"] - low, s["at"] - low), F.lit("["), s["kind"], F.lit("]")).alias("out"))).otherwise(F.struct(F.greatest(a["at"], s["upto"]).alias("at"), a["out"].alias("out")))
            return F.aggregate(own, start, step, lambda a: a["out"])

        return F.struct(high.alias("at"), F.concat(acc["out"], F.array(let(piece(text, low, high), inside))).alias("out"))

    stretches = F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(STRETCH)), lambda i: F.slice(spans, i, STRETCH))
    return F.aggregate(stretches, begin, stretch, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span, or run of spans that overlap, replaced by the kind of its first in brackets.

    n_chars, where docs has it, is counted anew.  A null text stays null.
    """
    kept = docs.columns
    base, spans = (free(kept, c) for c in ("base", "spans"))
    rows = with_spans(docs, fit(docs, text), text, (base, spans))
    rows = rows.withColumn(text, F.when(F.size(spans) > 0, _redacted(F.col(text), F.col(spans))).otherwise(F.col(text)))
    if "n_chars" in kept:
        rows = rows.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*kept)
