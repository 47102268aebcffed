"""Citations of acts in texts, and the graph of who cites whom.

The native functions serve codes and places.  The whole extraction turns texts into rows of mentions, in Python over
Arrow batches, since articles depend on the places of matches; names, shadows and repeats are joins and windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import citation_patterns as P
from lexloom.functions import legal_text as L
from lexloom.operators import names as name_index
from lexloom.schemas import CITATIONS

_EDGE = r"(?<![\p{L}\p{N}_])"
_END = r"(?![\p{L}\p{N}_])"


# ---------------------------------------------------------------- native


def codes(text: Column) -> Column:
    """All codes in a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{_EDGE}({P.CODE}){_END}"), F.lit(1))


def _last_number(text: Column, *patterns: str) -> Column:
    """Number of the last match, the plain spelling's match first."""
    found = [F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?iu){_EDGE}{p}{_END}"), F.lit(1)), F.lit(-1)) for p in patterns]
    return F.coalesce(*reversed(found)).cast("int")


def location(text: Column) -> dict[str, Column]:
    """Last article and clause that a text names; a spelling without accents outdoes one with; a point is never set."""
    return {"article": _last_number(text, P.ARTICLE, P.ARTICLE_ASCII), "clause": _last_number(text, P.CLAUSE, P.CLAUSE_ASCII), "point": F.lit(None).cast("string")}


def article_cut(text: Column, article: int) -> Column:
    """What stands from the first mention of an article to the next line that begins with one; empty without any."""
    return L.strip(F.regexp_extract(text, rf"(?isu)(Điều\s+0*{int(article)}{_END}.*?)(?=\n\s*Điều\s+0*\d+{_END}|\z)", 1))


def asked_articles(listed: Column) -> Column:
    """Numbers of a comma-separated list; what is no number is left out."""
    return F.transform(F.filter(F.transform(F.split(listed, ","), lambda x: L.strip(x)), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))


def _capped(rows: DataFrame, keys: list[str], order: list[str], quota: int | None) -> DataFrame:
    """Rows of a key up to the one that exhausts a quota of characters, so that what is collected next is bounded."""
    if quota is None:
        return rows
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__before", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))).where(F.col("__before") < quota).drop("__before")


def article_texts(chunks: DataFrame, quota: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """key, article, text: the chunks of an article in order, an empty line between.  chunks: chunk_id, corpus_id, content.

    With a quota, chunks behind it are left out and each is cut to it before it moves; who cuts texts to the quota misses
    nothing.  With asked (key, article), chunks of other articles are left out before any are sorted or gathered.
    """
    suffix = L.parse_corpus_id(F.col("corpus_id"))["suffix"]
    rows = chunks.select(L.lookup_key(L.code_of(F.col("corpus_id"))).alias("key"), suffix.alias("suffix"), "chunk_id", L.shown(F.col("content")).alias("t")).where(L.is_number(F.col("suffix")) & (F.col("t") != ""))
    rows = rows.withColumn("article", F.col("suffix").cast("int"))
    if quota is not None:
        rows = rows.withColumn("t", F.substring("t", 1, quota))
    if asked is not None:
        rows = rows.join(asked.select("key", "article").distinct(), ["key", "article"], "left_semi")
    rows = _capped(rows, ["key", "suffix"], ["chunk_id"], quota)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "t"))), lambda x: x["t"])
    return rows.groupBy("key", "article").agg(F.array_join(parts, "\n\n").alias("text"))


def act_texts(chunks: DataFrame, quota: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """key, text: all text of an act, by suffix and chunk; with a quota of characters or asked acts (key), as article_texts has it."""
    if asked is not None:
        chunks = chunks.withColumn("key", L.lookup_key(L.code_of(F.col("corpus_id")))).join(asked.select("key").distinct(), "key", "left_semi").drop("key")
    suffix = F.coalesce(F.expr("try_cast(nullif(suffix, '') AS int)"), F.lit(0))
    rows = chunks.select(L.lookup_key(L.code_of(F.col("corpus_id"))).alias("key"), L.parse_corpus_id(F.col("corpus_id"))["suffix"].alias("suffix"), "chunk_id", L.shown(F.col("content")).alias("t")).where("t <> ''")
    rows = _capped(rows.withColumn("suffix", suffix), ["key"], ["suffix", "chunk_id"], quota)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("suffix", "chunk_id", "t"))), lambda x: x["t"])
    return rows.groupBy("key").agg(F.array_join(parts, "\n\n").alias("text"))


def bulk_lookup(requests: DataFrame, texts: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """act_code, text: the asked articles (a comma-separated list) of an act, each under its heading, in the order asked.

    texts: those of all articles, or a function that gives them for the asked ones (key, article).
    """
    asked = requests.select("act_code", L.lookup_key(F.col("act_code")).alias("key"), F.posexplode(asked_articles(F.col("articles"))).alias("pos", "article"))
    found = asked.join(texts(asked) if callable(texts) else texts, ["key", "article"])
    section = F.concat(F.lit("Điều "), F.col("article").cast("string"), F.lit("\n"), F.col("text"))
    return found.groupBy("act_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("text"))


def graph(hits: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """cited, citing, citing_articles, cited_articles of hits (citing, citing_article, cited, article).

    Hits without an article count for nothing, nor do those of acts that are not allowed.
    """
    rows = hits.where(F.col("article").isNotNull() & F.col("cited").isNotNull())
    if allowed is not None:
        rows = rows.join(allowed.select(F.col("act").alias("cited")).distinct(), "cited", "left_semi")
    return rows.groupBy("cited", "citing").agg(F.array_sort(F.collect_set("citing_article")).alias("citing_articles"), F.array_sort(F.collect_set("article")).alias("cited_articles"))


def cited_articles(hits: DataFrame) -> DataFrame:
    """cited, articles: what all texts together cite of an act."""
    return hits.where("article IS NOT NULL AND cited IS NOT NULL").groupBy("cited").agg(F.array_sort(F.collect_set("article")).alias("articles"))


# ---------------------------------------------------------------- mentions by name


def _grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; a shorter text is its own run."""
    size = F.length(text)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), size - (n - 1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


#: Characters of the runs by which a name and a mention that holds it, or is held by it, find each other.
GRAM = 4


def name_matches(mentions: DataFrame, acts: DataFrame) -> DataFrame:
    """mention_id, act_code, score of the act that a mention (mention_id, window, year_hint) names best.

    A name that holds the mention's own words, or is held by them, scores its length, also where the one begins or
    ends inside a word of the other; else the shared words count.  A year that differs from the mention's costs one.
    Ties go to the later year, then to the smaller code.  A registry of a checked size goes to the workers as one index
    of its names; a larger one is joined by keys: acts of the mention's kind meet it that share a word or hold the
    other's first characters.
    """
    kind = F.coalesce(*[F.when(F.col("w").rlike(rf"\b{k}\b"), k) for k in P.KINDS])
    own = mentions.select("mention_id", "year_hint", L.name_form(F.col("window")).alias("w"))
    core = L.squeeze(F.regexp_replace("w", r"\b(" + "|".join(P.GENERIC) + r")\b", " "))
    own = own.select("mention_id", "year_hint", kind.alias("kind"), core.alias("core")).where("core <> ''")
    # of acts with one name and year the smallest code always wins, so it stands for them all
    titles = acts.groupBy(F.coalesce(F.nullif(F.col("act_name"), F.lit("")), "official_title").alias("title"), "year").agg(F.min("act_code").alias("act_code"))
    names = titles.select("act_code", "year", L.name_form(F.col("title")).alias("name")).where("name <> ''")
    named_kind = F.coalesce(*[F.when(F.col("name").startswith(k), k) for k in P.KINDS], F.lit("other"))
    names = names.groupBy("name", "year").agg(F.min("act_code").alias("act_code")).withColumn("name_kind", named_kind)
    rows = name_index.held(names)
    if rows is not None:
        return name_index.resolved(own, rows)
    # mentions worded alike mean the same act, so each wording is resolved once
    asked = own.select("year_hint", "kind", "core").distinct()
    words = lambda c: F.array_distinct(F.split(c, " "))
    # keys: words; of one text the first characters, of the other all runs as long, once each way round
    word = lambda c: F.transform(words(c), lambda x: F.concat(F.lit("w"), x))
    first = lambda c, mark: F.array(F.concat(F.lit(mark), F.substring(c, 1, GRAM)))
    runs = lambda c, mark: F.transform(F.array_distinct(F.flatten(F.array(*[_grams(c, n) for n in range(1, GRAM + 1)]))), lambda x: F.concat(F.lit(mark), x))
    keyed_own = asked.withColumn("key", F.explode(F.concat(word(F.col("core")), first(F.col("core"), "<"), runs(F.col("core"), ">"))))
    keyed_names = names.withColumn("key", F.explode(F.concat(word(F.col("name")), runs(F.col("name"), "<"), first(F.col("name"), ">"))))
    fits = F.col("kind").isNull() | (F.col("kind") == F.col("name_kind")) | ((F.col("kind") == "luat") & (F.col("name_kind") == "bo luat"))
    is_word = F.col("key").startswith("w")
    whole = is_word | F.contains("name", "core") | F.contains("core", "name")
    pairs = keyed_own.join(keyed_names, "key").where(fits & whole).groupBy("year_hint", "kind", "core", "act_code", "year", "name").agg(F.count_if(is_word).alias("common"))
    score = F.when(F.contains("name", "core"), F.length("core")).when(F.contains("core", "name"), F.length("name")).otherwise(F.col("common"))
    score = score - F.when(F.col("year_hint").isNotNull() & (F.coalesce("year", F.lit(-1)) != F.col("year_hint")), 1).otherwise(0)
    place = Window.partitionBy("year_hint", "kind", "core").orderBy(F.col("score").desc(), F.coalesce("year", F.lit(-1)).desc(), "act_code")
    best = pairs.withColumn("score", score).withColumn("n", F.row_number().over(place)).where("n = 1")
    best = best.select(F.col("year_hint").alias("__hint"), F.col("kind").alias("__kind"), F.col("core").alias("__core"), "act_code", "score")
    same = (F.col("core") == F.col("__core")) & F.col("kind").eqNullSafe(F.col("__kind")) & F.col("year_hint").eqNullSafe(F.col("__hint"))
    return own.join(best, same).select("mention_id", "act_code", "score")


# ---------------------------------------------------------------- the whole extraction


@lru_cache(maxsize=1)
def _patterns() -> dict:
    c = lambda p, flags=re.IGNORECASE: re.compile(p, flags)
    return {
        "code": re.compile(rf"\b{P.CODE}\b"), "prefixed": c(P.PREFIXED), "named": [c(P.NAMED), c(P.NAMED_ASCII)], "kind": [c(P.KIND_ALONE), c(P.KIND_ALONE_ASCII)],
        "articles": [c(P.ARTICLES), c(P.ARTICLES_ASCII)], "article": [c(rf"\b{p}\b") for p in (P.ARTICLE, P.ARTICLE_ASCII)], "clause": [c(rf"\b{p}\b") for p in (P.CLAUSE, P.CLAUSE_ASCII)],
    }


def _numbers(*matches) -> list[int]:
    """Numbers of lists of articles, each once."""
    return list(dict.fromkeys(int(n) for m in matches for n in re.findall(r"\d{1,3}", m.group(0))))


def _found(patterns, text: str) -> list:
    return [m for p in patterns for m in p.finditer(text)]


class Mentions:
    """The mentions of one text, each with the articles that go with it, before names are resolved.

    A mention by code is (method ID, code); one by name has no code yet, and the year that its accented spelling names.
    """

    def __init__(self, by_name: bool = True):
        self.by_name = by_name

    @staticmethod
    def around(text: str, begin: int, end: int) -> str:
        return text[max(0, begin - P.RADIUS) : end + P.RADIUS]

    def _of_code(self, text: str, begin: int, end: int) -> list[int]:
        """Articles of the last list before a code, else of the first after it."""
        p = _patterns()["articles"]
        before = _found(p, text[max(0, begin - P.RADIUS) : begin])
        after = [m for m in (q.search(text[end : end + P.RADIUS]) for q in p) if m]
        return _numbers(*(before[-1:] or after[:1]))

    def spans(self, text: str):
        """(begin, end, code, method, year, articles) of each mention."""
        p = _patterns()
        for pattern, group in ((p["code"], 0), (p["prefixed"], 1)):
            for m in pattern.finditer(text):
                yield (*m.span(group), m.group(group), "ID", None, self._of_code(text, *m.span()))
        for i, pattern in enumerate([*p["named"], *p["kind"]] if self.by_name else []):
            for m in pattern.finditer(text):
                yield (*m.span(), None, "NAME", int(m.group(1)) if i == 0 else None, _numbers(*_found(p["articles"], self.around(text, *m.span()))))

    def __call__(self, text: str | None) -> list[dict]:
        """A row for each mention and article, in the order found."""
        out, p = [], _patterns()
        for begin, end, code, method, year, articles in self.spans(text or ""):
            window = self.around(text, begin, end)
            last = {n: next((int(m.group(1)) for m in reversed(_found(p[n], window))), None) for n in ("article", "clause")}
            own = {"clause": last["clause"], "act_code_raw": code, "method": method, "year_hint": year, "span_start": begin, "span_end": end, "text_window": window}
            out += [own | {"article": a} for a in articles or [last["article"]]]
        return out


_RAW = {"article": "int", "clause": "int", "act_code_raw": "string", "method": "string", "year_hint": "int", "span_start": "int", "span_end": "int", "text_window": "string"}


def extract(df: DataFrame, key: str, text: str, by_name: bool = True, article_only: bool = False, acts: DataFrame | None = None) -> DataFrame:
    """key and the columns of CITATIONS: a row a citation.  acts: registry entries (act_code, act_name, official_title, year).

    Mentions become rows; those by name are resolved by a join with the registry, and stay ambiguous without a match.
    An ambiguous one with an article near (SHADOW) a code's with the same article goes.  An act and article of a text
    count once, the earliest.  Null texts have no citations; rows that share a key count as one text.
    """

    def run(batches):
        find = Mentions(by_name)
        for batch in batches:
            keys, places, rows = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = find(t)
                keys += [k] * len(own)
                places += range(len(own))
                rows += own
            columns = [pa.array([r[n] for r in rows], pa.int32() if kind == "int" else pa.string()) for n, kind in _RAW.items()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(places, pa.int32()), *columns], names=["__key", "place", *_RAW])

    kind = df.schema[key].dataType.simpleString()
    hits = df.select(F.col(key).alias("__key"), text).mapInArrow(run, f"__key {kind}, place int, " + ", ".join(f"{n} {t}" for n, t in _RAW.items()))
    if acts is not None and by_name:
        mention = F.struct("__key", "span_start", "span_end", "year_hint")
        named = hits.where("method = 'NAME'").select(mention.alias("mention_id"), F.col("text_window").alias("window"), "year_hint").dropDuplicates(["mention_id"])
        found = name_matches(named, acts).select(F.col("mention_id").alias("__m"), F.col("act_code").alias("__code"))
        hits = hits.join(found, (F.col("method") == "NAME") & (mention == F.col("__m")), "left").withColumn("act_code_raw", F.coalesce("act_code_raw", "__code")).drop("__m", "__code")
    hits = hits.withColumns({"act_code_norm": L.ascii_code(F.col("act_code_raw")), "ambiguity": F.col("act_code_raw").isNull(), "point": F.lit(None).cast("string"), "middle": F.expr("(span_start + span_end) div 2")})
    if article_only:
        hits = hits.withColumn("clause", F.lit(None).cast("int"))
    # windows over a text's citations of one article see whether a code's is near; what is dropped is never a code's
    near = Window.partitionBy("__key", "article").orderBy("middle").rangeBetween(-P.SHADOW, P.SHADOW)
    shadowed = (F.col("method") == "NAME") & F.col("ambiguity") & F.col("article").isNotNull() & (F.count_if(F.col("method") == "ID").over(near) > 0)
    first = Window.partitionBy("__key", F.coalesce("act_code_norm", "act_code_raw"), "article").orderBy("place")
    hits = hits.withColumn("__gone", shadowed).where("NOT __gone").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return hits.select(F.col("__key").alias(key), *CITATIONS.fieldNames())
