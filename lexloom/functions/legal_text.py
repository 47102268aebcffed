"""Column functions over the ids, codes, names and texts of legal acts.

Everything here is a built-in expression, so it stays inside code generation.  Missing parts of an id are empty
strings, not nulls.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Canonical spelling of act types.
TYPE_CODES = {
    "nđ-cp": "NĐ-CP", "nd-cp": "NĐ-CP",
    "tt-bca": "TT-BCA", "tt-bnn": "TT-BNN", "tt-btc": "TT-BTC", "tt-btp": "TT-BTP", "tt-bnv": "TT-BNV",
    "qh13": "QH13", "qh14": "QH14", "qh15": "QH15",
}
#: The same with the types that only the code export knows.
TYPE_CODES_WIDE = TYPE_CODES | {"tt-byt": "TT-BYT", "tt-bkhcn": "TT-BKHCN"}
#: Kinds of acts in words, by type.
TYPE_TITLES = {
    "nđ-cp": "Nghị định", "nd-cp": "Nghị định",
    "tt": "Thông tư", "tt-bca": "Thông tư", "tt-byt": "Thông tư",
    "ttlt": "Thông tư liên tịch", "ttlt-bca-btp-vksndtc-tandtc": "Thông tư liên tịch",
    "qđ-ttg": "Quyết định", "qd-ttg": "Quyết định",
    "lh": "Luật", "qh": "Luật",
}
UNTITLED = "Văn bản pháp luật"
#: Number and year, type, suffix of a corpus id; matched at the beginning only.
CORPUS_ID = r"^(\d{2,4}/\d{4})/([\p{L}\p{N}_-]+)(\+\d+)?"
#: Address and slugs of the second register, by the abbreviation a code's last part begins with.
SLUG_BASE = "https://luatminhkhue.vn"
SLUGS = {
    "TT": "thong-tu", "TTLT": "thong-tu-lien-tich", "NĐ": "nghi-dinh", "NĐ-CP": "nghi-dinh", "NQ": "nghi-quyet",
    "QH": "luat", "QĐ": "quyet-dinh", "CT": "chi-thi", "L": "lenh", "PL": "phap-lenh",
}
#: Labels of the register's key-value rows.
PAGE_FIELDS = {"so_hieu": "Số ký hiệu", "loai_van_ban": "Loại văn bản", "co_quan_ban_hanh": "Cơ quan ban hành", "trich_yeu": "Trích yếu"}
#: Words that mark a title line, and labels of a document's head.
TITLE_WORDS = ["luật", "nghị định", "thông tư", "quyết định", "hiến pháp"]
HEAD_FIELDS = {
    "reference_number": r"Số[:\s]+([^\n]+)",
    "issuing_body": r"Cơ\s*quan\s*ban\s*hành[:\s]+([^\n]+)",
    "promulgation_date": r"Ngày\s*ban\s*hành[:\s]+([^\n]+)",
    "effective_date": r"Ngày\s*có\s*hiệu\s*lực[:\s]+([^\n]+)",
    "status": r"Tình\s*trạng[:\s]+([^\n]+)",
}
#: Characters that a cleaned text keeps.
KEPT = r"[^a-zA-Z0-9\s\x{c0}-\x{1ef9}.,;:!?()\[\]\"'\-\n_–—…/§“”‘’]"


#: What counts as blank at the ends of a text and between words: all white space of Unicode and the separators 1C to 1F.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The same as a pattern's character class, for Java and RE2.
BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """text without blanks at its ends."""
    return F.btrim(text, F.lit(BLANKS))


#: What tokens are made of.
WORD = r"[\p{L}\p{N}_]"


def _folding(form: str) -> tuple[str, str]:
    """Letters that differ from their decomposed form by marks only, and what is left; then the marks themselves."""
    pairs, marks = [], []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize(form, chr(i)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and plain != chr(i):
            pairs.append((chr(i), plain))
    marks = [chr(i) for i in range(0x300, 0x370) if unicodedata.category(chr(i)) == "Mn"]
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


FOLD = _folding("NFD")
#: đ is a letter of its own and no accented d; where it counts as one, it is named.
FOLD_D = ("Đđ" + FOLD[0], "Dd" + FOLD[1])


#: Letters that the short tables don't fold: all but ASCII, Latin, combining marks and syllables of Hangul.
ODD = r"[^\x00-\x{24f}\x{300}-\x{36f}\x{1e00}-\x{1eff}\x{ac00}-\x{d7a3}]|[\x{80}-\x{bf}ßŉſĲĳĿŀǄ-ǌǱ-ǳẖ-ẟ]"


@lru_cache(maxsize=1)
def _folds() -> str:
    """The letters of ODD that folding changes and what becomes of them, by Unicode's own rules, as a JSON object."""
    out = {}
    for i in [*range(0x80, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c.replace("Đ", "D").replace("đ", "d")) if unicodedata.category(x) != "Mn").casefold()
        if folded != c:
            out[c] = folded
    return json.dumps(out, ensure_ascii=False)


def _mapped(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(pairs, value), otherwise)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def parse_corpus_id(corpus_id: Column) -> dict[str, Column]:
    """type, number (with the year), year, suffix."""
    part = lambda i: _or_empty(F.regexp_extract(corpus_id, CORPUS_ID, i))
    number = part(1)
    return {"type": F.lower(part(2)), "number": number, "year": F.split_part(number, F.lit("/"), F.lit(-1)), "suffix": F.ltrim(part(3), F.lit("+"))}


def code_of(corpus_id: Column) -> Column:
    """The act's code: what stands before the suffix."""
    return strip(F.split_part(_or_empty(corpus_id), F.lit("+"), F.lit(1)))


def lenient_parts(corpus_id: Column) -> dict[str, Column]:
    """code, number_year and type of ids with at least three parts; nulls for others."""
    parts = F.split(F.split_part(_or_empty(corpus_id), F.lit("+"), F.lit(1)), "/")
    whole = F.size(parts) >= 3
    return {"number_year": F.when(whole, F.concat_ws("/", F.slice(parts, 1, 2))), "type": F.when(whole, F.get(parts, 2))}


def act_code(code: Column, types: dict[str, str] = TYPE_CODES) -> Column:
    """Canonical code: number/year/TYPE; codes of fewer parts in upper case, further parts dropped."""
    code = strip(_or_empty(code))
    parts = F.split(code, "/")
    kind = F.get(parts, 2)
    whole = F.concat_ws("/", F.get(parts, 0), F.get(parts, 1), _mapped(F.lower(kind), types, F.upper(kind)))
    return F.when(F.size(parts) < 3, F.upper(code)).otherwise(whole)


def lookup_key(code: Column) -> Column:
    """Key under which spellings of a code meet: compatible forms decomposed, accents dropped, case folded, đ as d."""
    code = strip(_or_empty(code))
    plain = F.lower(F.translate(code, *FOLD_D))
    # letters outside of what the short table and lower() cover, one by one
    by_letter = F.transform(F.split(code, ""), lambda c: F.coalesce(F.try_element_at(F.from_json(F.lit(_folds()), "map<string,string>"), c), F.lower(F.translate(c, *FOLD_D))))
    return F.when(code.rlike(ODD), F.array_join(by_letter, "")).otherwise(plain)


def ascii_code(code: Column) -> Column:
    """Code without accents, dashes as hyphens, case kept; null stays null."""
    return F.translate(F.translate(code, "–—", "--"), *FOLD_D)


def name_form(name: Column) -> Column:
    """Name without accents (đ stays), lower-cased, single spaces."""
    return strip(F.regexp_replace(F.lower(F.translate(_or_empty(name), *FOLD)), BLANK + "+", " "))


def crawler_id(code: Column) -> Column:
    return F.upper(F.replace(_or_empty(code), F.lit(" "), F.lit("")))


def title(kind: Column, number: Column) -> Column:
    """Act's kind in words and its number; without a kind the number, or a constant."""
    kind, number = _or_empty(kind), _or_empty(number)
    named = F.concat(_mapped(F.lower(kind), TYPE_TITLES, F.upper(kind)), F.lit(" "), number, F.lit("/"), F.upper(kind))
    return F.when(kind == "", F.when(number == "", F.lit(UNTITLED)).otherwise(number)).otherwise(named)


def display(code: Column, name: Column, official: Column, article: Column) -> Column:
    """How an act, or an article of it, is shown."""
    name, official = F.nullif(name, F.lit("")), F.nullif(official, F.lit(""))
    whole = F.coalesce(name, official, code)
    return F.when(article.isNull(), whole).otherwise(F.concat(F.coalesce(name, code), F.lit(" — Điều "), article.cast("string")))


def similarity(score: Column) -> Column:
    """Inner product of unit vectors as a share from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least((score + 1) / 2, F.lit(1.0)))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(_or_empty(text), BLANK + "+"), lambda w: w != ""))


def doc_text(title: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.nullif(strip(_or_empty(title)), F.lit("")), F.nullif(strip(_or_empty(text)), F.lit("")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(_or_empty(text)), F.lit(WORD + "+"), F.lit(0))


def shown(text: Column) -> Column:
    """Underscores of segmented words as spaces."""
    return strip(F.replace(_or_empty(text), F.lit("_"), F.lit(" ")))


def spaced(text: Column) -> Column:
    """Line ends and blanks normalised, tags to spaces, punctuation set apart; lines stay."""
    t = F.regexp_replace(F.regexp_replace(_or_empty(text), r"\r\n?", "\n"), "<[^>]+>", " ")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}|\t", " "), r"""([,;:.!?)(\[\]"'])""", " $1 ")


def kept(text: Column, stopwords: list[str] | None = None, keep_underscore: bool = True) -> Column:
    """Stop words, underscores and odd characters dropped, as asked."""
    t = text
    if stopwords:
        stop = F.array(*map(F.lit, stopwords))
        t = F.array_join(F.filter(F.split(t, BLANK + "+"), lambda w: (w != "") & ~F.array_contains(stop, F.lower(w))), " ")
    if not keep_underscore:
        t = F.replace(t, F.lit("_"), F.lit(" "))
    # frequent characters are let go before KEPT's long class is asked
    return strip(F.regexp_replace(t, r"(?![a-z ])(?![A-Z0-9\x{c0}-\x{1ef9}\s.,])" + KEPT, ""))


def clean(text: Column, stopwords: list[str] | None = None, keep_underscore: bool = True) -> Column:
    """A text spaced, and what is kept of it."""
    return kept(spaced(text), stopwords, keep_underscore)


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(_or_empty(text), BLANK + "+", " "))


def head_title(text: Column) -> Column:
    """First of ten lines that names a kind of act, else 'Unknown'."""
    lines = F.transform(F.slice(F.split(_or_empty(text), "\n"), 1, 10), lambda s: strip(s))
    known = lambda s: F.lower(s).rlike("|".join(TITLE_WORDS)) & ~s.startswith("<")
    return F.coalesce(F.get(F.filter(lines, known), 0), F.lit("Unknown"))


def head_field(text: Column, pattern: str) -> Column:
    """Value after a label in the first 120 lines; null without one."""
    head = F.array_join(F.slice(F.split(_or_empty(text), "\n"), 1, 120), "\n")
    return F.nullif(strip(F.regexp_extract(head, "(?iu)(?<![\\p{L}\\p{N}_])" + pattern, 1)), F.lit(""))


def heading(chapter: Column, section: Column, article: Column, name: Column) -> Column:
    """Context line, and the article's line with its name."""
    context = F.concat_ws(" – ", F.nullif(chapter, F.lit("")), F.nullif(section, F.lit("")))
    own = F.concat(F.lit("Điều "), article, F.when(_or_empty(name) == "", "").otherwise(F.concat(F.lit(". "), name)))
    return F.when(context == "", own).otherwise(F.concat(context, F.lit("\n"), own))


def article_text(chapter, section, article, name, body) -> Column:
    head = heading(chapter, section, article, name)
    head = F.when(head.endswith(".."), F.rtrim(head, F.lit("."))).otherwise(head)
    return strip(F.concat(head, F.lit("\n"), _or_empty(body)))


def clause_text(chapter, section, article, name, clause, body) -> Column:
    return strip(F.concat(heading(chapter, section, article, name), F.lit(" - Khoản "), clause, F.lit(". "), _or_empty(body)))


def point_text(chapter, section, article, name, clause, point, body) -> Column:
    return strip(F.concat(heading(chapter, section, article, name), F.lit(" - Khoản "), clause, F.lit(" - Điểm "), point, F.lit(") "), _or_empty(body)))


def masked(text: Column, secret: Column | str) -> Column:
    secret = F.lit(secret) if isinstance(secret, str) else secret
    return F.when(_or_empty(secret) == "", text).otherwise(F.replace(text, secret, F.lit("***")))


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]+$"), F.lit(False))


def slug_url(code: Column) -> Column:
    """Address of an act in the second register; null where its kind is unknown."""
    last = F.upper(F.split_part(code, F.lit("/"), F.lit(-1)))
    kind = _mapped(F.regexp_extract(last, "^([A-Z]+)", 1), {k: v for k, v in SLUGS.items() if k.isascii()}, F.lit(None).cast("string"))
    return F.concat(F.lit(SLUG_BASE + "/van-ban/"), kind, F.lit("-"), F.lower(F.replace(code, F.lit("/"), F.lit("-"))), F.lit(".aspx"))


def page_field(html: Column, label: str) -> Column:
    """Text of the cell beside the last cell that holds a label, in rows of two cells."""
    rows = F.regexp_extract_all(_or_empty(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: squeeze(F.regexp_replace(c, "<[^>]+>", ""))))
    named = F.filter(cells, lambda r: (F.size(r) == 2) & F.contains(F.get(r, 0), F.lit(label)))
    return F.get(F.try_element_at(named, F.lit(-1)), 1)
