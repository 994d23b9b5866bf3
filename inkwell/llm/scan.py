"""Problem 3: noise in text from scanned pages.

A noisy channel: a shape-confusion table says what may have been read for what, counts over the
whole corpus say what is usual in a context, and each line is decoded by Viterbi over the candidates
of its suspicious characters and words. Running titles are what returns at the head or foot of the
pages of one document, allowing for small damage; page numbers are numbers in such a place that
equal the page's own. Words split at a line end with a mark are joined.

The counts are kept in a table of fixed size (BUCKETS counters over hashed contexts), so what is
broadcast does not grow with the corpus; collisions only make a count too high, hence a correction
less likely.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.arrays import code_points, mix64, strings
from inkwell.llm.lookalike import canonical, canonical_points
from inkwell.plans.cut import cut

BUCKETS = 1 << 21
#: Characters that scanners confuse (fixed values): true, read. Each pair holds in both directions.
CONFUSED = (
    "人入 石右 主王 料科 题題 没设 问间 证诬 句旬 语诏 船般 材村 时吋 看着 木术 候侯 未末 天夭 己已 已巳 土士 日曰 目自 大太 千干 干于 今令 鸟乌 白自 "
    "处外 折拆 免兔 兵乒 夫失 午牛 刀力 田由 由甲 甲申 贝见 同问 代伐 历厉 治冶 往住 侍待 微徽 候候 晴睛 拔拨 泪汨 淮准 栗粟 衰哀 辨辩 密蜜 第笫 "
    "末来 元无 九几 八入 文丈 犬大 本木 体休 传仿 休体 清清 情请 话活 洒酒 坏环 怀坏 析折 枝技 推椎 扰拢 仓仑 风凤 冈刚 闪问 闲间 闷问 厂广 厅厂 户卢 了丁 子孑 心必 手毛 斤斥 月用 水永 氷水 火灭 父交 王玉 玉主 禾木 穴六 立产 纪记 细组 绘给 编偏 谁准 读续 赢羸 轮轻 辆俩 边过 远运 近迈 还坏 这还 进迸 钓钩 铃铨 阅问 陪陷 霜箱 顶项 颗额 飘瓢 饱泡 驶驻 高亮"
).split()
#: Characters read as two (fixed values): true, read.
SPLIT = {"的": "白勺", "明": "日月", "好": "女子", "林": "木木", "村": "木寸", "他": "亻也", "你": "亻尔", "树": "木对", "时": "日寸", "朋": "月月", "加": "力口", "和": "禾口", "如": "女口", "知": "矢口", "吗": "口马", "呢": "口尼", "胡": "古月", "功": "工力", "阳": "阝日", "她": "女也", "妈": "女马", "以": "丨人", "引": "弓丨", "北": "丬匕", "化": "亻七", "休": "亻木", "课": "讠果", "话": "讠舌", "说": "讠兑", "语": "讠吾"}
#: Latin letters that scanners confuse (fixed values): read, true.
LATIN = [("c", "e"), ("0", "o"), ("í", "i"), ("1", "l"), ("5", "s"), ("li", "h"), ("cl", "d"), ("9", "g"), ("rn", "m"), ("vv", "w"), ("ii", "u"), ("6", "b"), ("8", "B"), ("1", "i"), ("nn", "m"), ("tl", "d"), ("q", "g")]
#: What any reading but a word's own begins with, and the readings by their first letter.
DOUBTFUL = re.compile("|".join(sorted({read for read, _ in LATIN})))
READINGS: dict[str, list[tuple[str, str]]] = {}
for _read, _true in LATIN:
    READINGS.setdefault(_read[0], []).append((_read, _true))
#: Parameters: how often a reading must stand against its correction to count as its own, and how often the correction must occur at least.
RATIO, LEAST = 0.1, 6
SIDE_RATIO, SIDE_LEAST = 0.03, 40
WORD_RATIO, WORD_LEAST = 0.08, 12
HYPHENS = "-‐‑­¬"
SPLIT_WORD = re.compile(rf"([^\W\d_]+)[{HYPHENS}][ \t​-‏⁠﻿]*\n[ \t]*([^\W\d_]+)")
MARKED_END = re.compile(rf"[{HYPHENS}][ \t​-‏⁠﻿]*\n")
WRAPPED_WORD = re.compile(r"(?<=[^\W\d_])[-¬]\n(?=[a-zà-ɏ])")
HYPHENED = re.compile(r"(?<![^\W\d_])([^\W\d_]+)-(?=([^\W\d_]+))")
LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏ0-9]*[A-Za-zÀ-ɏ][A-Za-zÀ-ɏ0-9]*")
DIGIT_INSIDE = re.compile(r"(?:[a-zà-ɏ]|^)[a-zà-ɏ]*[a-zà-ɏ][01569][a-zà-ɏ]|^[01569][a-zà-ɏ]{3,}|[a-zà-ɏ]{3,}[01569]$")
LETTER, DIGIT = re.compile(r"[^\W\d_]"), re.compile(r"\d")
IDEOGRAPH = re.compile(r"[㐀-鿿]")
#: What may stand around a page number: signs, and the zero that is drawn as a ring (a word character for re).
_DRESS = r"[\W_〇○◯]*"
#: A line that is nothing but a page number, in any of the usual dresses.
NUMBER_LINE = re.compile(rf"^{_DRESS}(?:语文|数学|英语)?{_DRESS}(?:第|p\.?|pp\.?|page|seite)?\s*(\d{{1,5}})\s*页?\s*(?:(?:/|of|von|sur|[,|·(]?\s*共)\s*\d{{1,5}}\s*页?)?{_DRESS}$", re.I)
#: A page number at the head or end of a line, beside something else.
NUMBER_BESIDE = re.compile(rf"^{_DRESS}(?:第\s*)?(\d{{1,5}})(?:\s*页)?(?:\s*[〇○◯])*(?:\s{{2,}}|\s*[|·—~•/-]\s*)\D|\D(?:\s{{2,}}|\s*[|·—~•/-]\s*)(?:[〇○◯]\s*)*(?:第\s*)?(\d{{1,5}})(?:\s*页)?{_DRESS}$")
LIST_ITEM = re.compile(r"^\s*(?:[-*•·]\s|\(|\d{1,3}[.、)]\s*\D|[A-D][.、]|#|\|)")
SENTENCE_END = re.compile(r"[。.!?！？…,，;；:：—”»\"、]$")
EDGE_LINES, LONGEST_TITLE = 2, 60
#: A running title stands on at least so many pages, and on such a share of the document's.
TITLE_PAGES, TITLE_SHARE, TITLE_EDITS = 2, 0.2, 2
#: A form of title is known if the titles of so many documents have it; then neither number nor share of pages counts.
FORM_DOCS = 3


@lru_cache(None)
def _confusions() -> tuple[dict[int, list[int]], np.ndarray, np.ndarray]:
    table: dict[int, set[int]] = {}
    for pair in CONFUSED:
        a, b = map(ord, pair)
        if a != b:
            table.setdefault(a, set()).add(b)
            table.setdefault(b, set()).add(a)
    doubtful = np.zeros(0x10000, bool)  # signs that may have been read for another one
    doubtful[list(table)] = True
    doubtful[0xE000 : 0xE000 + len(_PRIVATE)] = True
    known = doubtful.copy()
    known[[ord(c) for c in SPLIT]] = True
    return {k: sorted(v) for k, v in table.items()}, known, doubtful


def _hash3(kind: int, a, b, c):
    """Bucket of a context of three code points; kind keeps left, middle and right contexts apart."""
    x = (np.asarray(a, np.uint64) << np.uint64(42)) ^ (np.asarray(b, np.uint64) << np.uint64(21)) ^ np.asarray(c, np.uint64)
    with np.errstate(over="ignore"):
        return (mix64(x ^ np.uint64(kind << 60)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _word_buckets(word: str) -> tuple[int, int]:
    """Two buckets of a word; its count is the smaller of theirs."""
    h = int.from_bytes(hashlib.blake2b(word.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h % BUCKETS, (h >> 32) % BUCKETS


#: Code points that stand for the halves of a split character in contexts.
_PRIVATE = {v: 0xE000 + i for i, v in enumerate(SPLIT.values())}
_READ = {sign: read for read, sign in _PRIVATE.items()}
_SIGN = re.compile(f"[{''.join(map(chr, _READ))}]")


@lru_cache(None)
def _classes() -> tuple[np.ndarray, ...]:
    """Over 16-bit code points (the last stands for all beyond): letters, what LATIN_WORD consists of, what stands
    before and behind a wrapped line's end, the first and second signs of split characters."""
    letter, latin, before, behind, first, second = (np.zeros(0x10000, bool) for _ in range(6))
    letter[[c for c in range(0xFFFF) if LETTER.match(chr(c))]] = True
    letter[0xFFFF] = True  # others may be letters
    latin[[c for c in range(0x250) if 0xC0 <= c or chr(c).isascii() and chr(c).isalnum()]] = True
    behind[0x3400:0xA000] = True
    before |= behind
    before[[ord(c) for c in ",。、;:"]] = True
    first[[ord(v[0]) for v in _PRIVATE]] = True
    second[[ord(v[1]) for v in _PRIVATE]] = True
    return letter, latin, before, behind, first, second


def _padded(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the texts, each between two line breaks on either side; where each of these begins)."""
    starts = offsets[:-1] + 4 * np.arange(len(offsets) - 1)
    out = np.full(len(cps) + 4 * len(starts), 10, np.uint32)
    inside = np.ones(len(out), bool)
    for k in range(2):
        inside[starts + k] = inside[starts + np.diff(offsets) + 2 + k] = False
    out[inside] = cps
    return out, starts


def _flow(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Padded texts with wrapped Chinese lines joined and split characters as one private sign."""
    _, _, before, behind, first, second = _classes()
    low = np.minimum(cps, 0xFFFF).astype(np.uint16)
    at = np.flatnonzero(low == 10)[1:-1]
    at = at[before[low[at - 1]] & behind[low[at + 1]]]
    if len(at):
        cps, low, starts = np.delete(cps, at), np.delete(low, at), starts - np.searchsorted(at, starts)
    at = np.flatnonzero(first[low])
    at = at[second[low[at + 1]]]
    order = {v: i for i, v in enumerate(_PRIVATE)}
    found = sorted((order[v], i, v) for i, v in zip(at.tolist(), map("".join, zip(map(chr, low[at].tolist()), map(chr, low[at + 1].tolist())))) if v in order)
    taken: set[int] = set()  # as if each were replaced in turn
    gone = []
    if found:
        cps = cps.copy()
    for _, i, v in found:
        if i not in taken and i + 1 not in taken:
            taken |= {i, i + 1}
            gone.append(i + 1)
            cps[i] = _PRIVATE[v]
    if gone:
        gone = np.sort(np.array(gone, np.int64))
        cps, starts = np.delete(cps, gone), starts - np.searchsorted(gone, starts)
    return cps, starts


def _contexts(cps: np.ndarray, only_doubtful: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(positions of confusable signs, kind-wise buckets [3, n]) over padded texts."""
    _, known, doubtful = _confusions()
    at = np.flatnonzero((doubtful if only_doubtful else known)[np.minimum(cps, 0xFFFF)])
    a, b, x, c, d = (cps[at + k] for k in range(-2, 3))
    return at, np.stack([_hash3(1, a, b, x), _hash3(2, b, x, c), _hash3(3, x, c, d)])


def _latin_words(cps: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(runs of what LATIN_WORD consists of, also those of digits alone, over padded texts; where each begins)."""
    latin = _classes()[1]
    inside = latin[np.minimum(cps, 0xFFFF)]
    at = np.flatnonzero(inside)
    if not len(at):
        return [], at
    new = np.r_[True, np.diff(at) > 1]
    # One space before each run but the first.
    x = np.insert(cps[at], np.flatnonzero(new)[1:], 32)
    return x.astype(np.uint32).tobytes().decode("utf-32-le").split(" "), at[new]


def _add_words(total: np.ndarray, words: Counter) -> None:
    for w, n in words.items():
        if w.isdigit():
            continue
        for b in set(_word_buckets(w)):
            total[b] += n
    words.clear()


def _hyphened(a: str, b: str) -> list[str]:
    """Keys under which a compound is counted: several, so that collisions don't make one up."""
    return [f"{a}{'-' * k}{b}" for k in (1, 2, 3)]


def corpus_counts(records: DataFrame) -> np.ndarray:
    """BUCKETS counts of contexts and words over all records(…, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        words: Counter = Counter()
        letter = _classes()[0]
        for p in it:
            cps, offsets = canonical_points(p.column(0).to_pylist())
            padded, starts = _padded(cps, offsets)
            words.update(_latin_words(padded)[0])
            marks = np.flatnonzero(padded == 45)
            marks = marks[letter[np.minimum(padded[marks - 1], 0xFFFF)] & letter[np.minimum(padded[marks + 1], 0xFFFF)]]
            for i in np.unique(np.searchsorted(starts, marks, "right") - 1).tolist():
                for a, b in HYPHENED.findall(strings(cps[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])[0]):
                    words.update(_hyphened(a, b))
            total += np.bincount(_contexts(_flow(padded, starts)[0])[1].ravel(), minlength=BUCKETS)
            if len(words) > 200_000:
                _add_words(total, words)
        _add_words(total, words)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["b", "n"])

    rows = records.select("text").where("text is not null").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[rows["b"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _candidates(x: int) -> list[int]:
    table = _confusions()[0]
    own = list(table.get(x, ()))
    if 0xE000 <= x < 0xE000 + len(_PRIVATE):
        own.append(ord(list(SPLIT)[x - 0xE000]))
    return own


def _misread(cps: np.ndarray, counts: np.ndarray) -> dict[int, int]:
    """Over padded texts in flow form: position -> decoded code point, of the signs the channel corrects."""
    out: dict[int, int] = {}
    at, buckets = _contexts(cps, only_doubtful=True)
    if not len(at):
        return out
    seen = counts[buckets]
    # All alternatives of all positions at once; few survive.
    signs, which = np.unique(cps[at], return_inverse=True)
    table = [_candidates(int(x)) for x in signs]
    better: dict[int, list[tuple[float, int]]] = {}
    for k in range(max(map(len, table))):
        c = np.array([t[k] if len(t) > k else 0 for t in table], np.int64)[which]
        ok = c > 0
        i, c = at[ok], c[ok]
        left, right = cps[i - 1], cps[i + 1]
        alt = counts[np.stack([_hash3(1, cps[i - 2], left, c), _hash3(2, left, c, right), _hash3(3, c, right, cps[i + 2])])]
        own = seen[:, ok]
        middle = (alt[1] >= LEAST) & (own[1] <= RATIO * alt[1])
        side = ((alt[[0, 2]] >= SIDE_LEAST) & (own[[0, 2]] <= SIDE_RATIO * alt[[0, 2]])).any(0)
        strong = (middle | side) & ~((own > alt) & (own >= LEAST)).any(0)
        for j in np.flatnonzero(strong):
            score = float(np.log((alt[:, j] + 0.5) / (own[:, j] + 0.5)).sum())
            better.setdefault(int(i[j]), []).append((score, int(c[j])))
    # Viterbi over neighbouring suspicious signs: the choice at one changes the context of the next.
    groups: list[list[int]] = []
    for p in sorted(better):
        if groups and p - groups[-1][-1] <= 2:
            groups[-1].append(p)
        else:
            groups.append([p])
    for g in groups:
        out |= _viterbi(g, cps, better, counts)
    return out


def _misread_signs(texts: list[str], counts: np.ndarray) -> list[dict[int, int]]:
    """Per text in flow form: position -> decoded code point, of the signs the channel corrects."""
    out: list[dict[int, int]] = [{} for _ in texts]
    cps, starts = _padded(*code_points(texts))
    for p, c in _misread(cps, counts).items():
        t = int(np.searchsorted(starts, p, "right")) - 1
        out[t][p - int(starts[t]) - 2] = c
    return out


def _viterbi(group: list[int], cps: np.ndarray, better: dict[int, list[tuple[float, int]]], counts: np.ndarray) -> dict[int, int]:
    """Best readings of neighbouring signs by the sum of log counts of their middle contexts and the channel."""
    if len(group) == 1:
        score, c = max(better[group[0]])
        return {group[0]: c} if score > 0 else {}
    stay, change = math.log(0.97), math.log(0.03)
    states = [[(int(cps[p]), stay)] + [(c, change) for _, c in better[p]] for p in group]

    def local(i: int, left: int, c: int, right: int) -> float:
        return math.log(counts[int(_hash3(2, left, c, right))] + 0.5)

    paths = {(None, s[0]): (s[1], [s[0]]) for s in states[0]}
    for i in range(1, len(group)):
        gap = group[i] - group[i - 1]
        nxt: dict = {}
        for c, channel in states[i]:
            for (before, prev), (score, path) in paths.items():
                p = group[i - 1]
                left = before if before is not None and i > 1 and group[i - 1] - group[i - 2] == 1 else int(cps[p - 1])
                s = score + channel + local(i - 1, left, prev, c if gap == 1 else int(cps[p + 1]))
                if (prev, c) not in nxt or s > nxt[prev, c][0]:
                    nxt[prev, c] = (s, path + [c])
        paths = nxt
    best = None
    for (prev, c), (score, path) in paths.items():
        p = group[-1]
        left = prev if p - group[-2] == 1 else int(cps[p - 1])
        s = score + local(len(group) - 1, left, c, int(cps[p + 1]))
        if best is None or s > best[0]:
            best = (s, path)
    return {p: c for p, c in zip(group, best[1]) if c != int(cps[p])}


class Words:
    """Corrections of Latin words, with what was decided before kept."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.good, self.bad = counts, set(), {}

    def n(self, word: str) -> int:
        a, b = _word_buckets(word)
        return min(int(self.counts[a]), int(self.counts[b]))

    def wrong(self, words: set[str]) -> dict[str, str]:
        """word -> decoded word, for those that the channel explains as another."""
        out = {}
        for w in words:
            if w in self.good:
                continue
            better = self.bad.get(w) or self._correct(w)
            if better:
                out[w] = self.bad[w] = better
            else:
                self.good.add(w)
        if len(self.good) + len(self.bad) > 500_000:
            self.good, self.bad = set(), {}
        return out

    def _correct(self, word: str) -> str | None:
        if len(word) < 3 or word.isdigit() or word.isupper() and any(c.isdigit() for c in word):
            return None
        if DOUBTFUL.search(word):
            best = self._decoded(word)
            if best:
                return best
        if DIGIT_INSIDE.search(word) and any(c.islower() for c in word):
            return "".join({"0": "o", "1": "l", "5": "s", "9": "g", "6": "b"}.get(c, c) for c in word)
        return None


    def _decoded(self, word: str) -> str | None:
        """The usual word that takes fewest changes, if the word itself is not usual beside it."""
        beam = {0: [("", 0)]}
        for i, c in enumerate(word):  # Viterbi over the readings of each place; at most three changes a word
            here = [(len(read), true) for read, true in READINGS.get(c, ()) if word.startswith(read, i)]
            for built, changes in beam.pop(i, []):
                beam.setdefault(i + 1, []).append((built + c, changes))
                if changes < 3:
                    for n, true in here:
                        beam.setdefault(i + n, []).append((built + true, changes + 1))
            if len(beam.get(i + 1, ())) > 64:
                beam[i + 1] = sorted(beam[i + 1], key=lambda b: b[1])[:64]
        own, best = None, None
        for built, changes in beam.get(len(word), []):
            if changes and len(built) >= 3:
                n = self.n(built)
                if n >= WORD_LEAST:
                    own = self.n(word) if own is None else own
                    if own <= WORD_RATIO * n and (best is None or (changes, -n) < best[0]):
                        best = ((changes, -n), built)
        return best and best[1]


def _letters(line: str) -> str:
    return "".join(filter(str.isalpha, line.lower()))


def title_parts(line: str, page: int | None) -> tuple[str, bool]:
    """(letters of the line, empty for a bare page number; whether the page's number is in it)."""
    if not DIGIT.search(line):
        return _letters(line), False
    if m := NUMBER_LINE.match(line):
        return "", int(m.group(1)) == page
    m = NUMBER_BESIDE.search(line)
    return _letters(line), bool(m) and int(m.group(1) or m.group(2)) == page


def is_split_word(a: str, b: str, words: Words) -> bool:
    """Whether a mark between a and b at a line end split one word (and is no part of a compound): a
    compound stands inside lines with its mark, more often than without and not by chance for its
    halves. Only counts are compared with counts, so the answer doesn't change with the corpus's size."""
    if not b[:1].islower() or IDEOGRAPH.search(a + b):
        return False
    marked = min(map(words.n, _hyphened(a, b)))
    return not (marked > words.n(a + b) and marked * 20 >= min(words.n(a), words.n(b)))


def scan_lines(records: DataFrame, counts: np.ndarray | None) -> DataFrame:
    """(name, key, doc, page, hyphen, misread, lines): what can be told of each record by itself.

    records(name, key, doc, page, text, inside): inside says whether running lines may stand anywhere
    (a question that goes over a page) or only at head and foot. lines holds the places that may be
    a running title or a page number: array of (sig, number). Without counts hyphen and misread are false.
    """
    known = None if counts is None else records.sparkSession.sparkContext.broadcast(counts)
    line = pa.struct([("sig", pa.string()), ("number", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known and Words(known.value)
        for p in it:
            raw = p.column("text").to_pylist()
            cps, offsets = canonical_points(raw)
            texts = strings(cps, offsets)
            misread, hyphen = np.zeros(len(raw), bool), [False] * len(raw)
            if words:
                misread = _misread_texts(texts, *_padded(cps, offsets), words)
                hyphen = [bool(MARKED_END.search(t)) and any(is_split_word(m[1], m[2], words) for m in SPLIT_WORD.finditer(t)) for t in raw]
            lines = [edge_lines(t, n, i) for t, n, i in zip(texts, p.column("page").to_pylist(), p.column("inside").to_pylist())]
            ends = np.cumsum([0, *map(len, lines)])
            each = pa.StructArray.from_arrays([pa.array([l[k] for own in lines for l in own], t.type) for k, t in enumerate(line)], fields=list(line))
            columns = [p.column(c) for c in ("name", "key", "doc", "page")] + [pa.array(hyphen, pa.bool_()), pa.array(misread), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)]
            yield pa.RecordBatch.from_arrays(columns, ["name", "key", "doc", "page", "hyphen", "misread", "lines"])

    return records.mapInArrow(run, "name string, key string, doc string, page int, hyphen boolean, misread boolean, lines array<struct<sig:string,number:boolean>>")


def _misread_texts(texts: list[str], padded: np.ndarray, starts: np.ndarray, words: Words) -> np.ndarray:
    """Whether each text has signs or words that the channel corrects; padded holds the texts' code points."""
    out = np.zeros(len(texts), bool)
    flow, begin = _flow(padded, starts)
    out[np.searchsorted(begin, sorted(_misread(flow, words.counts)), "right") - 1] = True
    wrapped = np.flatnonzero(((padded == 45) | (padded == 0xAC))[:-1] & (padded[1:] == 10))
    wrapped = np.unique(np.searchsorted(starts, wrapped, "right") - 1)
    own, at = _latin_words(padded)
    wrong = words.wrong({w for w in set(own) if not w.isdigit()})
    bad = np.searchsorted(starts, at[[w in wrong for w in own]], "right") - 1 if wrong else np.zeros(0, np.int64)
    out[np.setdiff1d(bad, wrapped)] = True
    for i in wrapped.tolist():  # words that go over a line's end count as joined
        out[i] = out[i] or bool(words.wrong(set(LATIN_WORD.findall(WRAPPED_WORD.sub("", texts[i])))))
    return out


def edge_lines(text: str, page: int | None, inside: bool) -> list[tuple[str, bool]]:
    """(sig, number) of the lines of a text in one form that may be a running title or hold the page's number."""
    flat = text.split("\n")
    if inside:
        flat = [l for x in flat if (l := x.strip())]
    elif len(flat) > 2 * EDGE_LINES:
        head: list[str] = []
        n = 0
        for n, x in enumerate(flat, 1):
            if l := x.strip():
                head.append(l)
                if len(head) == EDGE_LINES:
                    break
        tail: list[str] = []
        for x in reversed(flat[n:]):
            if l := x.strip():
                tail.append(l)
                if len(tail) == EDGE_LINES:
                    break
        flat = head + tail[::-1]
    else:
        flat = [l for x in flat if (l := x.strip())]
    out = []
    for line in flat:
        if len(line) <= LONGEST_TITLE:
            if DIGIT.search(line) and NUMBER_LINE.match(line):
                if title_parts(line, page)[1]:
                    out.append(("", True))
            elif not SENTENCE_END.search(line) and not LIST_ITEM.match(line):
                sig, number = title_parts(line, page)
                if len(sig) >= 3:
                    out.append((sig, number))
    return out


def _form(title):
    """How a title ends before its number: 4 ideographs or 8 letters; null if nothing stands before them."""
    bare = F.regexp_replace(title, "[零〇一二三四五六七八九十百]+$", "")
    size = F.when(F.substring(bare, -1, 1).rlike("[\\x{3400}-\\x{9fff}]"), 4).otherwise(8)
    return F.when(F.length(bare) > size, F.right(bare, size))


def title_places(lines: DataFrame) -> DataFrame:
    """One row for each different signature at the edges of a document's pages, with the pages it stands on."""
    pages = lines.groupBy("doc").agg(F.count_distinct(F.when(F.col("name") == "page_texts", F.col("page"))).alias("pages"))
    each = lines.select("doc", "name", "page", "key", F.explode("lines").alias("l")).where("length(l.sig) >= 4")
    on = each.groupBy("doc", F.col("l.sig").alias("title")).agg(
        F.count_distinct(F.when(F.col("name") == "page_texts", F.col("page"))).alias("p"), F.count_distinct(F.when(F.col("name") != "page_texts", F.col("key"))).alias("q"), F.max(F.when(F.col("name") == "page_texts", F.col("page"))).alias("last")
    )
    enough = (F.col("p") >= TITLE_PAGES) & (F.col("p") >= TITLE_SHARE * F.col("pages")) | (F.col("q") >= 3) & (F.col("p") >= 1)
    return on.join(pages, "doc").withColumn("enough", enough).withColumn("form", _form(F.col("title")))


def running_titles(lines: DataFrame, on: DataFrame) -> DataFrame:
    """(doc, title): signatures of title_places that return at the edges of enough pages of a document, and those of a
    form known from other documents that stand off page 1 of a document with page numbers or other titles."""
    sure = on.where("enough")
    forms = sure.where("form is not null").groupBy("form").agg(F.count_distinct("doc").alias("docs"), F.max(F.length("title")).alias("most")).where(F.col("docs") >= FORM_DOCS)
    numbered = lines.where("name = 'page_texts' and exists(lines, l -> l.sig = '' and l.number)").select("doc")
    furnished = numbered.unionByName(sure.select("doc")).distinct()
    more = on.where("not enough and last > 1").join(forms, "form").where(F.length("title") <= F.col("most") + TITLE_EDITS).join(furnished, "doc", "left_semi")
    return sure.select("doc", "title").unionByName(more.select("doc", "title"))


def title_forms(on: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc, sig): signatures of title_places that are a running title of their document or a few edits off. Each
    different signature is compared once, and with titles of about its length only: a large document has many lines."""
    most = F.least(F.lit(TITLE_EDITS), F.floor(F.length("title") / 4)).cast("int")
    near = titles.select("doc", "title", most.alias("most"), F.explode(F.sequence(F.length("title") - most, F.length("title") + most)).alias("n"))
    own = on.select("doc", F.col("title").alias("sig"), F.length("title").alias("n"))
    alike = (F.col("sig") == F.col("title")) | F.levenshtein(F.col("sig"), F.col("title"), TITLE_EDITS).between(0, F.col("most"))
    return own.join(near, ["doc", "n"]).where(alike).select("doc", "sig").distinct()


def scan_noise(records: DataFrame) -> DataFrame:
    """(name, key, kind): the kinds of noise in each of records(name, key, doc, page, text, inside).

    Null keys and null or empty texts give no row; a null doc has no running titles, a null page no
    page numbers; repeated rows count once.
    """
    records = records.where("key is not null and text is not null and text <> ''").select("name", "key", "doc", F.col("page").cast("int").alias("page"), "text", "inside")
    lines = cut(scan_lines(records, corpus_counts(records)))
    known = lines.where("doc is not null")
    on = cut(title_places(known))
    forms = cut(title_forms(on, running_titles(known, on)))
    each = lines.select("name", "key", "doc", F.explode("lines").alias("l"))
    found = each.where("length(l.sig) >= 4").withColumn("sig", F.col("l.sig")).join(forms, ["doc", "sig"], "left_semi")
    return (
        found.select("name", "key", F.lit("header").alias("kind"))
        .unionByName(each.where("l.number and l.sig = ''").unionByName(found.where("l.number").select(*each.columns)).select("name", "key", F.lit("page_number").alias("kind")))
        .unionByName(lines.where("hyphen").select("name", "key", F.lit("hyphen").alias("kind")))
        .unionByName(lines.where("misread").select("name", "key", F.lit("misread").alias("kind")))
        .distinct()
    )


def _near(a: str, b: str, most: int) -> bool:
    """Whether at most `most` edits lead from a to b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def _joined(lines: list[str]) -> list[str]:
    """Lines that only the page's width broke, put together: a line goes on in the next one if the
    next one's first sign or word had no room in it. Items, verse, short lines and ends of sentences stay."""
    out: list[str] = []
    for i, line in enumerate(lines):
        before = lines[i - 1] if i else ""
        if out and before and line and not LIST_ITEM.match(line):
            width = max(len(before), len(line), len(lines[i - 2]) if i > 1 else 0)
            ideographs = IDEOGRAPH.search(before[-2:] or " ") or IDEOGRAPH.match(line)
            room = width - len(before)
            word = 1 if ideographs else len(line.split(" ", 1)[0]) + 1
            full = room <= 1 if ideographs else room < word
            if full and len(before) >= 12 and not re.search(r"(?:[。.!?！？]|——)$", before):
                out[-1] += line if ideographs else " " + line
                continue
        out.append(line)
    return out


def repair_texts(texts: list[str], pages: list[int | None], inside: list[bool], titles: list[list[str] | None], words: Words) -> list[str]:
    """The texts without running titles and page numbers, split words joined, misread signs and words
    decoded, broken lines put together."""
    texts = canonical([SPLIT_WORD.sub(lambda m: m[1] + m[2] + "\n" if is_split_word(m[1], m[2], words) else m[0], t) if MARKED_END.search(t) else t for t in texts])
    flows = [_body(*x) for x in zip(texts, pages, inside, titles)]
    for k, fixed in enumerate(_misread_signs(flows, words.counts)):
        if fixed:
            signs = list(flows[k])
            for at, c in fixed.items():
                signs[at] = chr(c)
            flows[k] = "".join(signs)
        if _SIGN.search(flows[k]):
            flows[k] = flows[k].translate(_READ)
    own = [LATIN_WORD.findall(f) for f in flows]
    wrong = words.wrong({w for x in own for w in x})
    if wrong:
        flows = [LATIN_WORD.sub(lambda m: wrong.get(m[0], m[0]), f) if any(w in wrong for w in x) else f for f, x in zip(flows, own)]
    return [re.sub(r"\n{3,}", "\n\n", f).strip("\n") for f in flows]


def _body(text: str, page: int | None, inside: bool, titles: list[str] | None) -> str:
    """A text in one form without running titles and page numbers, broken lines put together, split characters as one private sign."""
    lines = text.split("\n")
    full = [i for i, l in enumerate(lines) if l.strip()]
    edge = set(full if inside else full[:EDGE_LINES] + full[-EDGE_LINES:])
    kept = []
    for i, line in enumerate(lines):
        if i in edge and len(line) <= LONGEST_TITLE:
            sig, number = title_parts(line.strip(), page)
            if number and not sig or len(sig) >= 4 and any(_near(sig, t, min(TITLE_EDITS, len(t) // 4)) for t in titles or ()):
                continue
        kept.append(line.strip())
    flow = "\n".join(_joined(kept))
    for read, sign in _PRIVATE.items():
        if read in flow:
            flow = flow.replace(read, chr(sign))
    return flow


def repaired_texts(records: DataFrame) -> DataFrame:
    """(name, key, text, changed): each of records(name, key, doc, page, text, inside) in continuous paragraphs.

    Null keys give no row; null and empty texts stay as they are.
    """
    records = records.where("key is not null").select("name", "key", "doc", F.col("page").cast("int").alias("page"), "text", "inside")
    full = records.where("text is not null and text <> ''")
    counts = corpus_counts(full)
    lines = cut(scan_lines(full, None).where("doc is not null"))
    titles = cut(running_titles(lines, cut(title_places(lines)))).groupBy("doc").agg(F.collect_set("title").alias("titles"))
    known = records.sparkSession.sparkContext.broadcast(counts)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(known.value)
        for p in it:
            texts = p["text"].tolist()
            at = [i for i, t in enumerate(texts) if t]
            pages = [None if g != g or g is None else int(g) for g in p["page"]]
            own = repair_texts(*([x[i] for i in at] for x in (texts, pages, p["inside"].tolist(), [None if x is None else list(x) for x in p["titles"]])), words)
            for i, t in zip(at, own):
                texts[i] = t
            yield pd.DataFrame({"name": p["name"], "key": p["key"], "text": texts, "changed": [a != b for a, b in zip(texts, p["text"])]})

    return records.join(titles, "doc", "left").select("name", "key", "page", "text", "inside", "titles").mapInPandas(run, "name string, key string, text string, changed boolean")
