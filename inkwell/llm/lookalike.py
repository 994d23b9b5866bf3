"""Problem 2: visually identical text with different characters.

The texts of an Arrow batch are laid out as one array of positioned code points. Each is joined with
the mapping table (decompositions, look-alikes, invisible characters) by position in the table, which
is small, of fixed size, and built by rule in every worker; a code point becomes none, one or several.
Combining marks are put in order by class, composed with their base again, and the strings rebuilt.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.arrays import code_points, strings
from inkwell.plans.cut import cut
from inkwell.plans.pairs import salted_self_pairs

#: Letters of other scripts with the shape of a Latin letter (fixed values).
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ғ": "F",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "α": "a", "γ": "y", "ɡ": "g", "ɑ": "a", "ı": "i",
    # Armenian
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "զ": "q", "Օ": "O", "Ս": "U",
    # Punctuation and ideographs of other blocks
    "‐": "-", "‑": "-", "−": "-", "∕": "/", "⁄": "/", "∶": ":", "ː": ":", "․": ".", "‚": ",", "·": "·", "・": "·", "･": "·", "‧": "·", "∙": "·", "⋅": "·", "一": "一", "〇": "〇", ";": ";", "｀": "`", "ʼ": "'", "〸": "十", "ㅡ": "一",
}
#: Letters of Cherokee and Roman numerals with the shape of Latin capitals (fixed values).
LOOK_ALIKE |= {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z"}
#: Kana and Bopomofo with the shape of an ideograph, those of the public table of confusables (fixed values).
LOOK_ALIKE |= {"エ": "工", "オ": "才", "カ": "力", "タ": "夕", "ト": "卜", "ニ": "二", "ノ": "丿", "ハ": "八", "ロ": "口", "ー": "一", "ㄏ": "厂", "ㄒ": "丅", "ㄚ": "丫", "ㄗ": "卩", "ㆍ": "·"}
#: Compatibility tags whose decomposition is another form of the same sign. Raised, lowered and circled signs, fractions and squared words look different and stay.
SAME_SHAPE = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: <compat> decompositions that are taken: ligatures, radicals and letters; those that begin with a space, enclosed numbers and words are not.
_END = 0x30000


def _compat(ch: str, parts: list[int]) -> bool:
    name = unicodedata.name(ch, "")
    if parts[0] == 0x20:
        return len(parts) == 1  # a space of another width
    return "LIGATURE" in name or "RADICAL" in name or "DIGRAPH" in name or (len(parts) == 1 and unicodedata.category(ch)[0] in "LP") or len(parts) == 2 and unicodedata.category(ch)[0] == "L"


def _invisible(cp: int) -> bool:
    return unicodedata.category(chr(cp)) == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


@lru_cache(None)
def _tables():
    """(first code point and length of each expansion, where it starts in the flat list, that list,
    combining classes, keys and values of compositions)."""

    def full(cp: int) -> list[int]:
        ch = chr(cp)
        if _invisible(cp):
            return []
        if ch in LOOK_ALIKE and LOOK_ALIKE[ch] != ch:
            return full(ord(LOOK_ALIKE[ch]))
        if unicodedata.category(ch) == "Zs":
            return [0x20]
        d = unicodedata.decomposition(ch)
        if not d or 0xAC00 <= cp < 0xD7A4:
            return [cp]
        tag, *rest = d.split()
        if tag[0] == "<":
            parts = [int(x, 16) for x in rest]
            if not (tag in SAME_SHAPE or tag == "<compat>" and _compat(ch, parts)):
                return [cp]
        else:
            parts = [int(x, 16) for x in d.split()]
        return [y for x in parts for y in full(x)]

    length = np.ones(_END, np.uint8)
    first = np.arange(_END, dtype=np.uint32)
    start = np.zeros(_END, np.int32)
    flat: list[int] = []
    compose: dict[int, int] = {}
    for cp in range(0xA0, _END):
        ch = chr(cp)
        if 0x3400 <= cp < 0x9FFF and ch not in LOOK_ALIKE or 0x4E00 <= cp < 0xA000 or 0xAC00 <= cp < 0xF900 or 0x20000 <= cp < 0x2F800:
            continue
        e = full(cp)
        if e != [cp]:
            start[cp], length[cp], first[cp] = len(flat), len(e), e[0] if e else 0
            flat += e
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and len(d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            if unicodedata.combining(chr(b)):
                compose[(a << 21) | b] = cp
    keys = np.array(sorted(compose), np.int64)
    ccc = np.zeros(_END, np.uint8)
    for cp in range(0x300, 0x1F000):
        if c := unicodedata.combining(chr(cp)):
            ccc[cp] = c
    return first, length, start, np.array(flat, np.uint32), ccc, keys, np.array([compose[k] for k in keys.tolist()], np.uint32)


def canonical_points(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of the texts in one consistent form; None becomes the empty text. Idempotent."""
    first, length, start, flat, ccc, keys, values = _tables()
    cps, offsets = code_points(texts)
    high = len(cps) and int(cps.max()) >= _END  # beyond the planes that have mappings
    own = np.where(cps < _END, cps, 0) if high else cps
    n, out = length[own], first[own]
    if high:
        n[cps >= _END], out[cps >= _END] = 1, cps[cps >= _END]
        n[(cps >= 0xE0000) & (cps < 0xE1000)] = 0  # tags and variation selectors
    odd = np.flatnonzero(n != 1)
    if len(odd):
        total = np.zeros(len(odd) + 1, np.int64)
        np.cumsum(n[odd].astype(np.int64) - 1, out=total[1:])
        offsets = offsets + total[np.searchsorted(odd, offsets)]
        gone, many = odd[n[odd] == 0], odd[n[odd] > 1]
        if len(gone):
            out = np.delete(out, gone)
        if len(many):  # the further code points of an expansion go behind its first
            more = n[many].astype(np.int64) - 1
            ahead = np.cumsum(more) - more
            src = np.repeat(start[own[many]].astype(np.int64) + 1 - ahead, more) + np.arange(more.sum())
            place = np.repeat(many + 1 - np.searchsorted(gone, many), more)
            out = np.insert(out, place, flat[src])
    cc = ccc[np.minimum(out, _END - 1)] if high else ccc[out]
    marks = np.flatnonzero(cc)
    if len(marks):
        text = np.searchsorted(offsets, marks, "right")
        run = np.cumsum(np.r_[True, (np.diff(marks) != 1) | (np.diff(text) != 0)])
        order = np.lexsort((marks, cc[marks], run))
        out[marks], cc[marks] = out[marks][order], cc[marks][order]
        first = np.r_[True, np.diff(run) != 0]
        begin = marks[first]
        rank = marks - begin[run - 1]
        base = begin[run - 1] - 1
        fits = base >= np.r_[0, offsets][text]  # a mark at the head of a text has no base
        left = np.zeros(len(begin), np.uint8)  # class of the last mark of the run that stays
        lost = [np.zeros(0, np.int64)]
        for r in range(int(rank.max()) + 1):
            at = np.flatnonzero((rank == r) & fits)
            m, b, g = marks[at], base[at], run[at] - 1
            key = (out[b].astype(np.int64) << 21) | out[m]
            pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = (keys[pos] == key) & (left[g] < cc[m])
            out[b[ok]] = values[pos[ok]]
            lost.append(m[ok])
            left[g[~ok]] = cc[m[~ok]]
            if r > 64 and not ok.any():
                break  # no base takes a further mark
        gone = np.sort(np.concatenate(lost))
        offsets = offsets - np.searchsorted(gone, offsets)
        out = np.delete(out, gone)
    return out, offsets


def canonical(texts) -> list[str]:
    """The texts in one consistent form; None becomes the empty text. Idempotent."""
    return strings(*canonical_points(texts))


@F.pandas_udf(T.StringType())
def canonical_text(texts: pd.Series) -> pd.Series:
    """Column form of canonical(); null stays null."""
    return pd.Series(canonical(texts), index=texts.index, dtype=object).where(texts.notna(), None)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def canonical_digests(records: DataFrame) -> DataFrame:
    """records(name, key, text) -> (name, key, raw, canon): digests of the text as stored and of its
    one form. Null keys, null texts and those that are blank in their one form give no row."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            c = canonical(p["text"])
            full = np.array([bool(x.strip()) for x in c], bool)
            q = p.loc[full, ["name", "key"]].copy()
            q["raw"] = [_digest(t) for t, f in zip(p["text"], full) if f]
            q["canon"] = [_digest(t) for t, f in zip(c, full) if f]
            yield q

    return records.where("key is not null and text is not null").select("name", "key", "text").mapInPandas(run, "name string, key string, raw binary, canon binary")


def look_alike_pairs(records: DataFrame) -> DataFrame:
    """(name, left, right): keys of one table whose texts differ as stored and look the same."""
    return salted_self_pairs(cut(canonical_digests(records)), ["name", "canon"], "key", differ="raw").select("name", "left", "right")
