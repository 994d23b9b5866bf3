"""Problem 9: keyword-stuffed and link-list pages.

A page is cut into blocks: sentences, and runs of lines that end without a full stop. Of each block
are measured: the share of links and product tags, the share of the most frequent content word or
character pair, the share of repeated words, the density of separators and the share of function
words. A block is stuffed if links or tags fill it, or if its words repeat where function words are
missing, or if one content word fills a mock sentence. A page is found if stuffed blocks hold more
than half of its characters. How many function words are usual is measured per language over all
pages first, and so are repeated words and separators; the limits follow from that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the a an of to in on at by for from with and or but so that this is are was were be been has have had it its his her their our we you they not no as if until while although because after before behind beside under who when which than there all every any".split(),
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber doch von vom zu zum zur in im an am auf aus bei mit nach vor hinter neben unter über für um ist sind war wird werden wurde hat haben sich nicht niemand kein keine es sie er wir ihr dass weil wenn bis damit sodass während obwohl auch als wie noch nie".split(),
    "fr": "le la les un une des du de d l au aux et ou mais donc car que qu qui ce cette ces est sont était fut a ont sa son ses leur leurs il elle ils nous vous ne n pas plus en dans sur sous par pour avec sans à après avant pendant chaque si bien tandis jusqu se s y".split(),
}
#: Chinese function characters (fixed values).
FUNCTION_CHARS = set("的了在是有和与及或就都也不没还很而但因为所以虽然如果即使尽管直到从向把被让给对于到之其这那着过里上下后前中些什么")
#: Addresses: a scheme or www, or labels of two signs and more joined by dots of which the last is of 2 to 8 small letters
#: (a sentence that follows without a space begins with a capital).
_HOST = r"(?<![\w.@-])[A-Za-z0-9][\w-]+(?:\.[\w-]{2,})*\.[a-z]{2,8}(?![\w-])(?!\.\w)(?::\d+)?(?:/[^\s|,，；;·]*)?"
LINK = re.compile(r"(?i:https?://|www\.)[^\s|,，。；;·]+|" + _HOST, re.A)
TAG = re.compile(r"[^\W\d]\w*(?:-\w+)*-\d+\b|#\w+")
SITE = re.compile(r"(?i:https?://|www\.)|[\w-]\.[a-z]{2}", re.A)
TAGGED = re.compile(r"-\d|#\w")
WORD = re.compile(r"[^\W_]+", re.U)
CJK = re.compile(r"[㐀-鿿]")
ENDS = re.compile(r"(?<=[.!?…])[\"”»’']?(?=\s|$)|(?<=[。！？])[”」』]?|\n{2,}")
SEPARATOR = re.compile(r"[|/·•;,，、>:：»–—\n-]")
DIGIT = re.compile(r"\d")
_SPLIT = re.compile(r"[\s|/·•;,，、>:：–—-]+")
_FULL_END = re.compile(r"[.!?。！？…]$")
FUNCTION_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
FUNCTION_SETS["und"] = frozenset().union(*FUNCTION_SETS.values())
#: Shares from which a measure counts, at least (parameters); where a language's own median is high, ABOVE times that.
FUNCTION_LIMIT = 0.4  # of what is usual in the language
TOP_WORD, TOP_PAIR, REPEATED, SEPARATORS, LINKS, NUMBERS = 0.2, 0.24, 0.34, 0.3, 0.4, 0.4
ABOVE = 1.6
#: A list without repeats: words at least, words an entry at most (parameters).
LISTED, ENTRY = 8, 2.5
#: What is usual where nothing was measured: function words, the most frequent content word, repeated words, separators a word.
USUAL = {"function": 0.2, "top": 0.05, "again": 0.1, "separators": 0.1}


def _words(low: str) -> tuple[str, list[str], int]:
    """(language, words, ideographs) of a text in lower case: zh by script, else the language whose function
    words are most frequent, else und."""
    words = WORD.findall(low)
    han = 0 if low.isascii() else len(CJK.findall(low))
    if han * 4 > len(words):
        return "zh", words, han
    best, most = "und", 0
    for k in FUNCTION_WORDS:
        n = sum(map(FUNCTION_SETS[k].__contains__, words))
        if n > most:
            best, most = k, n
    return best, words, han


def language(text: str) -> str:
    return _words(text.lower())[0]


def _share(low: str, lang: str, words: list[str]) -> float:
    if lang == "zh":
        chars = CJK.findall(low)
        return sum(map(FUNCTION_CHARS.__contains__, chars)) / max(1, len(chars))
    return sum(map(FUNCTION_SETS[lang].__contains__, words)) / max(1, len(words))


def function_share(text: str, lang: str) -> float:
    """Function words (Chinese: characters) among all words (characters)."""
    low = text.lower()
    return _share(low, lang, WORD.findall(low))


def _repeats(items) -> int:
    """How many of the items stand there more than once, at most: one item more than this can't be repeated so often."""
    return len(items) - len(set(items)) + 1


def blocks(text: str) -> list[str]:
    """Sentences, and runs of lines without a full stop."""
    out = []
    for part in ENDS.split(text):
        part = part.strip()
        if not part:
            continue
        if "\n" in part:  # lines that stand without a full stop before the last one are a list of their own
            *head, last = part.split("\n")
            if _FULL_END.search(last) and len(last) > 2 * max(len(h) for h in head) and len(head) > 1:
                out += ["\n".join(head), last]
                continue
        out.append(part)
    return out


def _limits(usual: dict[str, dict[str, float]], lang: str) -> dict[str, float]:
    # Texts without a function word are no language of their own: what is usual among them is no measure.
    u = {**USUAL, **(usual.get(lang, {}) if lang != "und" else {})}
    return {
        "function": FUNCTION_LIMIT * u["function"], "top": max(TOP_WORD, ABOVE * u["top"]), "pair": max(TOP_PAIR, ABOVE * 2 * u["top"] if lang == "zh" else 0),
        "again": max(REPEATED, ABOVE * u["again"]), "separators": max(SEPARATORS, ABOVE * u["separators"]),
    }


def _size(text: str) -> int:
    return len("".join(text.split()))


def _stuffed(rest: str, lang: str, limit: dict[str, float]) -> bool:
    """Whether a block without links and tags is stuffed with words, numbers or menu entries. What costs
    more is counted only where the cheaper counts leave it open."""
    low = rest.lower()
    words = WORD.findall(low)
    share = _share(low, lang, words)
    few = share <= limit["function"]
    if few and DIGIT.search(rest):
        parts = rest.split()
        numbers = sum(DIGIT.search(t) is not None for t in parts)
        if numbers >= 2 and numbers >= NUMBERS * len(parts) and len(parts) >= 4:
            return True
    cjk = [] if low.isascii() else CJK.findall(low)
    if cjk and len(cjk) * 4 > len(words):
        pairs = [a + b for a, b in zip(cjk, cjk[1:]) if a not in FUNCTION_CHARS and b not in FUNCTION_CHARS]
        least = max(2, limit["pair"] / 2 * len(cjk))
        if _repeats(pairs) >= least and max(Counter(pairs).values(), default=0) >= least:
            return True
        if not few:
            return False
        tokens = [t for t in _SPLIT.split(rest) if t]
        return len(tokens) >= 6 and len(set(tokens)) <= (1 - limit["again"]) * len(tokens)
    own = FUNCTION_SETS.get(lang, FUNCTION_SETS["und"])
    heavy = [w for w in words if w not in own and not w.isdigit()]
    least = max(2, limit["top"] * len(words), limit["top"] * len(heavy))
    if heavy and _repeats(heavy) >= least and max(Counter(heavy).values()) >= least:
        return True
    if not few:
        return False
    content = [w for w in words if not w.isdigit()]
    if len(content) < 4:
        return False
    count = Counter(content)
    again = sum(n for n in count.values() if n > 1) / len(content)
    if again >= limit["again"] and max(count.values()) >= 3:
        return True
    lines = [l.strip() for l in rest.split("\n") if l.strip()]
    if 1 - len(set(lines)) / max(1, len(lines)) >= REPEATED:
        return True
    separators = len(SEPARATOR.findall(rest)) / max(1, len(words))
    # Repeated words between separators, or a list of entries of a word or two without a single function word.
    return separators >= limit["separators"] and (again >= limit["again"] or share == 0 and len(content) >= LISTED and separators >= 1 / ENTRY)


def stuffed_share(text: str, usual: dict[str, dict[str, float]], own: tuple[str, list[str], int] | None = None) -> float:
    """Share of the characters (without white space) that stand in stuffed blocks."""
    whole = _size(text)
    if not whole:
        return 0.0
    lang = (own or _words(text.lower()))[0]
    limit = _limits(usual, lang)
    bad = 0
    linked = SITE.search(text) is not None
    tagged = TAGGED.search(text) is not None
    shielded = LINK.sub(lambda m: m.group().replace(".", "\x00").replace("?", "\x01").replace("!", "\x02"), text) if linked else text
    for block in blocks(shielded):
        rest, marked = block, 0
        if linked:
            block = rest = block.replace("\x00", ".").replace("\x01", "?").replace("\x02", "!")
            marked = sum(m.end() - m.start() for m in LINK.finditer(block))
            rest = LINK.sub(" ", block)
        if tagged:
            marked += sum(m.end() - m.start() for m in TAG.finditer(rest))
            rest = TAG.sub(" ", rest)
        size = _size(block)
        if marked and marked >= LINKS * size:
            prose = sum(_size(l) for l in block.split("\n") if len(l) > 20 and not LINK.search(l) and not TAG.search(l) and function_share(l, language(l)) > limit["function"])
            bad += size - prose
        elif _stuffed(rest, lang, limit):
            bad += size
    return bad / whole


def usual_shares(documents: DataFrame) -> dict[str, dict[str, float]]:
    """Medians by language over all documents: share of function words, of the most frequent content word (in
    Chinese: pair of characters) and of repeated content words, separators a word. A few numbers per known language."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            for t in p["text"]:
                low = t.lower()
                lang, words, _ = _words(low)
                items = [a + b for a, b in zip(low, low[1:]) if CJK.match(a) and CJK.match(b)] if lang == "zh" else [w for w in words if w not in FUNCTION_SETS[lang]]
                count = Counter(items)
                n = max(1, len(items))
                rows.append((lang, _share(low, lang, words), max(count.values(), default=0) / n, (len(items) - len(count)) / n, len(SEPARATOR.findall(t)) / max(1, len(words))))
            yield pd.DataFrame(rows, columns=["lang", *USUAL])

    rows = documents.where("text is not null and length(text) > 0").select("text").mapInPandas(run, "lang string, " + ", ".join(f"{k} double" for k in USUAL))
    rows = rows.groupBy("lang").agg(*[F.percentile_approx(k, 0.5, 1000).alias(k) for k in USUAL])
    return {r["lang"]: {k: r[k] for k in USUAL} for r in rows.collect()}  # at most one row per entry of FUNCTION_WORDS, zh and und


def stuffed_pages(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, share) of documents(doc_id, text) of whose characters more than `least` are stuffed.

    Null ids and null, empty or blank texts give no row; repeated rows give repeated rows.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    usual = usual_shares(docs)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            p = p.assign(share=[stuffed_share(t, usual) for t in p["text"]])
            yield p.loc[p["share"] > least, ["doc_id", "share"]]

    return docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, share double")
