"""How citations of legal acts are written.  All patterns are read case-sensitively unless marked."""

from __future__ import annotations

UPPER = "A-ZĐÂÊÔƠƯÁÀẢÃẠĂẮẰẲẴẶẤẦẨẪẬÉÈẺẼẸẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢÚÙỦŨỤỨỪỬỮỰÝỲỶỸỴ"
#: A code: number of one to three digits, year of this or the last century, type of two or more capitals and hyphens.
CODE = rf"\d{{1,3}}/(?:19\d{{2}}|20\d{{2}})/[{UPPER}][{UPPER}-]+"
#: A kind of act, then within 40 characters a code; case-insensitive.
PREFIXED = rf"\b(?:nghị\s*định|thông\s*tư|quyết\s*định|luật|bộ\s*luật)[^\n\r]{{0,40}}?({CODE})\b"
#: A kind of act, then within 60 characters a year; a kind alone with 40 characters after it; case-insensitive.
NAMED = r"\b(?:bộ\s*luật|luật|nghị\s*định|thông\s*tư)[^\n\r]{0,60}?((?:19|20)\d{2})\b"
NAMED_ASCII = r"\b(?:bo\s*luat|luat|nghi\s*dinh|thong\s*tu)[^\n\r]{0,60}?((?:19|20)\d{2})\b"
KIND_ALONE = r"\b(?:bộ\s*luật|luật|nghị\s*định|thông\s*tư)[^\n\r]{0,40}"
KIND_ALONE_ASCII = r"\b(?:bo\s*luat|luat|nghi\s*dinh|thong\s*tu)[^\n\r]{0,40}"
#: A list of article numbers; an article, a clause; case-insensitive.
ARTICLES, ARTICLES_ASCII = r"điều\s+\d{1,3}(?:[\s,]*(?:và)?\s*\d{1,3})*", r"dieu\s+\d{1,3}(?:[\s,]*(?:va)?\s*\d{1,3})*"
ARTICLE, ARTICLE_ASCII = r"điều\s+(\d{1,3})", r"dieu\s+(\d{1,3})"
CLAUSE, CLAUSE_ASCII = r"khoản\s+(\d{1,2})", r"khoan\s+(\d{1,2})"
#: Characters around a mention that belong to it, and how near a code must be to silence an unresolved name.
RADIUS, SHADOW = 160, 120
#: Words of a mention that say nothing about which act is meant.
GENERIC = ["bo", "luat", "nghi", "dinh", "thong", "tu", "cua", "ve", "nam", "nay"]
#: Kinds as names begin with them; the first that a mention holds counts, and a `luat` may be a `bo luat`.
KINDS = ["bo luat", "luat", "nghi dinh", "thong tu"]
