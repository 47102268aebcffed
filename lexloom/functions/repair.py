"""Repair of texts whose UTF-8 was read as a one-byte encoding, as a whole or in places."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


#: Bytes as which the characters of both one-byte encodings stand.
_BYTES = {chr(b): b for b in range(0x80, 0x100)} | {c: b for b in range(0x80, 0x100) if (c := bytes([b]).decode("cp1252", "ignore"))}
_BEHIND = "[" + "".join(re.escape(c) for c, b in _BYTES.items() if b < 0xC0) + "]"
#: A byte that begins a sequence of two, three or four, and the bytes behind it.
_SEQUENCE = re.compile(f"[\u00c2-\u00df]{_BEHIND}|[\u00e0-\u00ef]{_BEHIND}{{2}}|[\u00f0-\u00f4]{_BEHIND}{{3}}")
#: Two-byte characters that stand alone in texts: accented letters, Vietnamese horns, signs of Latin-1.
_COMMON = re.compile("[\u00a0-\u017f\u01a0\u01a1\u01af\u01b0\u0300-\u036f]")


def _spans(text: str) -> str:
    """text with the best chain of its sequences that are UTF-8 decoded; the rest stays.

    A sequence counts 1 for it, or 1 against it where two characters would become an uncommon one; 2 more where it
    follows another that is decoded.  So a capital before a closing mark stays, a whole word in another script does not.
    """
    found = []
    for m in _SEQUENCE.finditer(text):
        try:
            better = bytes(_BYTES[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            continue
        found.append((*m.span(), better, 1 if len(m[0]) > 2 or _COMMON.match(better) else -1))
    # the best totals with the last sequence left (0) or decoded (1), and how they came about
    left, taken, back = 0, -(10**9), []
    for i, (begin, _, _, gain) in enumerate(found):
        joins = i > 0 and found[i - 1][1] == begin
        from_taken = taken + (2 if joins else 0)
        back.append((left < taken, left < from_taken))
        left, taken = max(left, taken), gain + max(left, from_taken)
    state, chosen = taken > left, []
    for i in range(len(found) - 1, -1, -1):
        if state:
            chosen.append(found[i])
        state = back[i][state]
    out, at = [], 0
    for begin, end, better, _ in reversed(chosen):
        out += [text[at:begin], better]
        at = end
    return "".join([*out, text[at:]])


def _repair(text: str) -> str:
    for _ in range(3):  # read wrongly more than once
        for encoding in ("cp1252", "latin-1"):
            try:
                better = text.encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
            break
        else:
            better = _spans(text)
        if better == text:
            break
        text = better
    return unicodedata.normalize("NFC", text)


def repaired(df: DataFrame, text: str) -> DataFrame:
    """df with its texts repaired and composed, and `changed`; what is no such error stays as it is, null stays null."""
    kept = [c for c in df.columns if c != "changed"]
    schema = df.select(*kept).schema.add("changed", T.BooleanType())
    place = kept.index(text)

    def run(batches):
        for b in batches:
            old = b.column(place).to_pylist()
            new = [None if t is None else _repair(t) for t in old]
            columns = [b.column(i) for i in range(len(kept))]
            columns[place] = pa.array(new, b.column(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x != y for x, y in zip(old, new, strict=True)])], names=[*kept, "changed"])

    return df.select(*kept).mapInArrow(run, schema)
