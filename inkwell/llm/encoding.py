"""Problem 5: text decoded with the wrong encoding.

For every pair (encoding of the bytes, encoding they were read in) the garbled form of each
character of the vocabulary is precomputed. One multi-pattern automaton finds all of them in one
pass. Matches that follow each other without a gap make a span; a span that is long enough to be no
chance is decoded back and replaced, the rest of the text stays as it is. U+FFFD is itself the trace
of a failed decoding: such a page is found, though what was lost cannot be restored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Single-byte encodings in which bytes are read by mistake (fixed values: Python codec names).
SINGLE = ["cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman", "mac-cyrillic", "iso8859-2", "iso8859-15", "cp1253", "cp1254"]
#: Multi-byte encodings in which UTF-8 bytes are read by mistake.
MULTI = ["gb18030", "big5", "cp932", "euc-kr", "euc-jp"]
#: What the bytes were.
SOURCES = ["utf-8", "gbk"]
#: Rounds of restoring: text garbled twice needs two.
ROUNDS = 3


@lru_cache(None)
def _vocabulary() -> list[str]:
    """Characters whose garbled forms are looked for: the rows of GB 2312, Latin letters with marks, general punctuation."""
    chars = []
    for row in [1, 3, *range(16, 88)]:
        for cell in range(1, 95):
            try:
                chars.append(bytes([0xA0 + row, 0xA0 + cell]).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    # What a first wrong reading gives is in the vocabulary too: controls, Latin letters and signs.
    chars += [chr(c) for c in (*range(0x80, 0x250), 0x2C6, 0x2DC, *range(0x2010, 0x2040))]
    chars += [chr(c) for c in (*range(0x386, 0x3CF), *range(0x401, 0x452))] + ["€", "™", "〇"]
    return list(dict.fromkeys(chars))


@lru_cache(None)
def _bytes_of(wrong: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; bytes it leaves undefined read as C1 controls."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(wrong)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(None)
def _automaton():
    import ahocorasick

    forms: dict[str, set[tuple[str, str]]] = {}
    reading = {wrong: {b: c for c, b in _bytes_of(wrong).items()} for wrong in SINGLE}
    for source in SOURCES:
        for ch in _vocabulary():
            try:
                raw = ch.encode(source)
            except UnicodeEncodeError:
                continue
            if len(raw) < 2 or (source == "gbk" and raw[1] < 0xA1):
                continue
            flat = raw.decode("latin-1")
            for wrong in SINGLE:
                forms.setdefault(flat.translate(reading[wrong]), set()).add((source, wrong))
    # UTF-8 read two bytes at a time: where a three-byte character begins with a unit, its third
    # byte makes one unit with the first byte of the next character.
    for ch in _vocabulary():
        raw = ch.encode("utf-8")
        if len(raw) == 3:
            for nxt in (0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEF):
                for wrong in MULTI:
                    try:
                        s = (raw + bytes([nxt])).decode(wrong)
                    except UnicodeDecodeError:
                        continue
                    if not any(x < "\x80" for x in s):
                        forms.setdefault(s, set()).add(("utf-8", wrong))
    a = ahocorasick.Automaton()
    for form, pairs in forms.items():
        a.add_word(form, (len(form), tuple(pairs)))
    a.make_automaton()
    return a


def _likely(span: str, source: str, wrong: str, tiles: int) -> bool:
    """Whether a chain of `tiles` garbled characters is no chance of ordinary writing."""
    letters = [unicodedata.category(c) for c in span]
    odd = any(x[0] != "L" for x in letters) or any(a == "Ll" and b == "Lu" for a, b in zip(letters, letters[1:]))
    if not odd:  # a word of an ordinary alphabet
        return False
    if source == "gbk":
        return tiles >= 3
    return len(span) >= 3 or letters[-1][0] != "L"


_SEQUENCE = re.compile(rb"(?:[\xe3-\xe9][\x80-\xbf]{2}|\xe2[\x80-\x8f][\x80-\xbf]|\xef[\xbc\xbd][\x80-\xbf]){3,}(?:[\xc3-\xc7][\x80-\xbf])*")


def _multi_spans(text: str, wrong: str, near: list[int]) -> Iterator[tuple[int, int, str]]:
    for run in re.finditer(r"[^\x00-\x7f�]{4,}", text):
        if not any(run.start() <= p < run.end() for p in near):
            continue
        raw, at = bytearray(), []
        for i, c in enumerate(run.group()):
            try:
                b = c.encode(wrong)
            except UnicodeEncodeError:
                b = b"\x00"
            at += [i] * len(b)
            raw += b
        for m in _SEQUENCE.finditer(bytes(raw)):
            s, e = at[m.start()], at[m.end() - 1] + 1
            if (m.start() == 0 or at[m.start() - 1] != s) and (m.end() == len(at) or at[m.end()] != e - 1):
                yield run.start() + s, run.start() + e, m.group().decode("utf-8")
            else:  # the span begins or ends inside a unit: found, but it can't be cut out without loss
                yield run.start() + s, run.start() + e, ""


def spans(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, source, wrong, restored) of the garbled spans, without overlap; restored is empty where it can't be."""
    if text.isascii():
        return []
    chains: dict[tuple[str, str], list[list[int]]] = {}
    anchors: dict[str, list[int]] = {}
    for end, (n, pairs) in _automaton().iter(text):
        start = end + 1 - n
        for pair in pairs:
            if pair[1] in MULTI:
                anchors.setdefault(pair[1], []).append(start)
                continue
            own = chains.setdefault(pair, [])
            for c in reversed(own[-3:]):
                if c[1] == start:
                    c[1], c[2] = end + 1, c[2] + 1
                    break
            else:
                own.append([start, end + 1, 1])
    found = []
    for (source, wrong), own in chains.items():
        table = _bytes_of(wrong)
        for s, e, tiles in own:
            if _likely(text[s:e], source, wrong, tiles):
                found.append((s, e, source, wrong, bytes(table[c] for c in text[s:e]).decode(source, "replace")))
    for wrong, near in anchors.items():
        found += [(s, e, "utf-8", wrong, r) for s, e, r in _multi_spans(text, wrong, near)]
    out: list[tuple[int, int, str, str, str]] = []
    for f in sorted(found, key=lambda f: (f[0] - f[1], SOURCES.index(f[2]), f[0], f[3])):
        if all(f[1] <= o[0] or f[0] >= o[1] for o in out):
            out.append(f)
    return sorted(out)


def restore(text: str | None) -> tuple[str | None, int, int, str]:
    """(text with garbled spans restored, restored spans, spans and marks that could not be, encodings met)."""
    if not text:
        return text, 0, 0, ""
    done, met = 0, set()
    lost = 0
    for _ in range(ROUNDS):
        own = spans(text)
        if not own:
            break
        parts, at, changed = [], 0, False
        lost = 0
        for s, e, source, wrong, r in own:
            met.add(f"{source}>{wrong}")
            if r and "�" not in r:
                parts += [text[at:s], r]
                at, changed, done = e, True, done + 1
            else:
                lost += 1
        text = "".join(parts) + text[at:]
        if not changed:
            break
    return text, done, lost + len(re.findall("�+", text)), ",".join(sorted(met))


def repair_encoding(records: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, restored_text, restored, lost, encodings) per record that holds garbled text.

    Records with null key or null, empty or clean text give no row; repeated rows give repeated rows.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = [(k, *restore(t)) for k, t in zip(p["k"], p["t"]) if t and not t.isascii()]
            yield pd.DataFrame([r for r in rows if r[2] or r[3]], columns=["key", "restored_text", "restored", "lost", "encodings"])

    kind = records.schema[key].dataType.simpleString()
    return records.where(records[key].isNotNull()).select(records[key].alias("k"), records[text].alias("t")).mapInPandas(run, f"key {kind}, restored_text string, restored int, lost int, encodings string")
