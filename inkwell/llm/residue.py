"""Problem 6: template residue, filler, error pages and script notices in place of content.

Each kind of placeholder has its own grammar by delimiter. Texts are brought to one form first, code
and quoted words are masked: what a text only cites is no residue. What remains is judged by where
it stands: some forms are residue anywhere, others only where they fill a line or a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from inkwell.llm.arrays import code_points
from inkwell.llm.lookalike import canonical

#: A word's edge that also holds between an ideograph and a letter.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
NAME = r"[^\W\d]\w{0,30}"
#: Grammars of unfilled fields, one per delimiter.
FIELDS = re.compile(
    "|".join(
        [
            r"\{\{\s*%s(?:[.|]\s*\w+)*\s*\}\}" % NAME,  # {{ name }}
            r"\$\{\s*%s(?:\.\w+)*\s*\}" % NAME,  # ${name}
            r"(?<![\w$#{\\^])\{\s*%s(?: %s)?\s*\}(?!\})" % (NAME, NAME),  # {name}, {first name}: no set or list
            r"\{%%-?\s*%s[^{}\n]{0,60}?-?%%\}" % NAME,  # {%% if name %%}
            r"\*\|\s*%s(?::%s)?\s*\|\*" % (NAME, NAME),  # *|NAME|*
            r"\[\[\s*%s\s*\]\]" % NAME,  # [[name]]
            r"<<\s*%s\s*>>" % NAME,  # <<name>>
            r"<%%[=-]?\s*%s(?:\.\w+)*\s*%%>" % NAME,  # <%= name %>
            r"(?<![A-Za-z0-9%%])%%%s%%(?![A-Za-z0-9])" % NAME,  # %name%
            r"(?<![A-Za-z0-9#])#%s#(?![A-Za-z0-9#])" % NAME,  # #name#
            r"@@\s*%s\s*@@" % NAME,  # @@name@@
            r"(?<![A-Za-z0-9_])__%s?__\s*(?:待填|待补|TBD)" % NAME,  # __name__ and a note to fill it in
            r"【[^【】\n]{1,20}】\s*:?\s*【\s*】",  # 【name】：【】
            r"[\[<(【]\s*(?:请|此处|在此|待)\s*(?:填写|输入|填入|补充|插入|替换)[^\[\]<>()【】\n]{0,20}[\]>)】]",  # a bracketed order to fill in
            r"[\[<]\s*(?:insert|enter|your|replace|fill in)\b[^\[\]<>\n]{0,40}[\]>]",
        ]
    ),
    re.I,
)
#: Notes of authors about what is missing.
NOTES = re.compile(r"(?<!\w)(?:TODO|FIXME|XXX|TBD)\s*[::]\s*\S|(?<!\w)(?:FIXME|TBC)\s+%s\s*$|TODO\s*:|\(?(?:内容)?整理中,?\s*(?:稍后|后续)(?:更新|补充)\)?|此处省略,?\s*(?:后续|稍后)(?:完善|补充)|(?:标题|文字|图片|内容|正文)占位|点击此处(?:添加|输入|编辑)(?:文本|文字|标题|内容)" % NAME, re.I | re.M)
FILLER = re.compile(
    r"\blorem\s+ipsum\b|\b(?:asdf|qwer|zxcv)(?:\s+(?:asdf|qwer|zxcv))+\b|(?<![A-Za-z0-9])x{5,}(?![A-Za-z0-9])|\byour\s+text\s+(?:goes\s+)?here\b|\binsert\s+\w+\s+here\b|([一-鿿])\1{4,}|([一-鿿]{2,6})\2{2,}|示例文字|这里是正文这里".replace(r"\b", EDGE),
    re.I,
)
ERRORS = re.compile(
    (r"\b[45]\d\d\s+(?:Not\s+Found|Bad\s+Gateway|(?:Service|Server)\s+(?:Temporarily\s+)?Unavailable|Forbidden|Unauthorized|Internal\s+Server\s+Error|Gateway)|\bgateway\s+time-?out\b|\b(?:resource|page|file)\b[^.\n]{0,40}\b(?:(?:could\s+not|can\s?not|can[’']t)\s+be\s+(?:located|found)|has\s+(?:been\s+)?moved|was\s+not\s+found|does\s+not\s+exist)"
    r"|\baccess\s+denied\b|\b(?:internal|fatal|parse|uncaught)\s+(?:server\s+)?error\s*:|\btemplate\s+not\s+rendered\b|\bundefined\s+(?:variable|undefined|index)\b|\btoo\s+many\s+requests\b|\[object\s+Object\]|\bchecking\s+that\s+you\s+are\s+human\b|\b(?:session|token)\s+(?:has\s+)?expired\b"
    r"|数据库连接失败|\berrno\s*=\s*\d+|(?:服务器|系统|网络)(?:繁忙|异常|错误|开小差)[,,]|请稍[后候](?:再试|重试|…|\.\.\.)|会话已过期|请重新登录后|无权限访问|您(?:访问|查找|请求)的(?:内容|页面|资源)[^。\n]{0,8}(?:走丢|不存在|已删除|找不到)|加载失败[,,]?\s*点击重试|正在(?:跳转|加载|验证)[,,]?\s*请稍候").replace(r"\b", EDGE),
    re.I,
)
NOTICES = re.compile(
    (r"(?:请|需要?|please|must|need\s+to)[^。.\n]{0,12}(?:启用|开启|打开|允许|enable|turn\s+on|activate|switch\s+on)[^。.\n]{0,16}(?:java\s*script|脚本|scripts?\b|js\b|cookies?)|\b(?:java\s*script|scripts?|js|cookies)\s+(?:is|are|must\s+be|to\s+be)?\s*(?:disabled|required|switched\s+on|turned\s+on|enabled)\b|\bscript-capable\s+browser\b|\bnoscript\s*:|(?:脚本|java\s*script)\s*(?:已?被|未)(?:禁用|启用|开启)|需要\s*(?:脚本|java\s*script)\s*支持|请(?:更换|升级)[^。\n]{0,6}浏览器|浏览器版本过低|browser\s+(?:is\s+)?(?:not\s+supported|out\s*dated|too\s+old)").replace(r"\b", EDGE),
    re.I,
)
#: Residue only where it fills a line or a sentence, or stands after a label.
ALONE = re.compile(r"(?:[^。\n:]{0,20}:\s*)?(?:待(?:补充|完善|填写|定|续|填|录入)|暂无(?:内容)?|略|同上[,,]?略|同上|TBD|TODO|FIXME|N/A|null|undefined|NaN|none|nil|占位符?|测试|test(?:ing)?(?:\s+test(?:ing)?)*)[。.!]?", re.I)
ALONE_WORD = re.compile(r"(?:待(?:补充|完善|填写|填|录入)|TBD|同上[,,]略)\s*$")
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|(?m:^(?: {4}|\t).*$)|`[^`\n]+`", re.S)
QUOTED = re.compile(r"“[^“”\n]{0,60}”|‘[^‘’\n]{1,60}’|\"[^\"\n]{1,60}\"|「[^「」\n]{1,60}」|『[^『』\n]{1,60}』|《[^《》\n]{1,60}》")
_ENDS = re.compile(r"(?<=[。!?！？])\s*")
MARKUP = re.compile(r"^\s*(?:#{1,6}\s*|[-*+>]\s+|\d+[.)]\s+)*(?:\*\*|__)?|(?:\*\*|__)?\s*$")
KINDS = {"field": FIELDS, "note": NOTES, "filler": FILLER, "error": ERRORS, "notice": NOTICES}
#: What a text must hold, in lower case, for a grammar to match at all: a part of each of its alternatives.
NEEDS = {
    "note": ["todo", "fixme", "xxx", "tbd", "tbc", "整理中", "此处省略", "占位", "点击此处"],
    "filler": ["lorem", "asdf", "qwer", "zxcv", "xxxxx", "your", "insert", "示例文字", "这里是正文"],
    "error": "40 41 42 43 44 45 50 51 52 53 54 55 gateway found located moved exist denied error rendered undefined requests [object human expired 数据库 errno 服务器 系统 网络 请稍 会话 请重新登录 无权限 您 加载 正在".split(),
    "notice": ["script", "脚本", "js", "cookie", "浏览器", "browser"],
}
_OPENS = re.compile(r"[{@*](?=[{@|\w\s%])|\$\{|\[\[|<[<%]|[%#]\w|__|【|[\[<(]\s*(?:请|此处|在此|待|insert|enter|your|replace|fill)")
#: Words by which a sentence speaks of such a thing instead of being it (for fields: of how it is written).
SPEAKS = {
    "field": re.compile(r"\b(?:syntax|placeholders?|variables?|templating|expands?|interpolat\w+|replaced\s+(?:by|with))\b|占位符|变量名|模板语法|模板引擎|会被替换|替换为", re.I),
    "error": re.compile(r"\b(?:said|says|saying|wrote|writes|reads?|whisper\w*|shout\w*|means?|meaning|called|messages?|phrases?|words?|status\s+codes?|returns?|responds?|answers?|shows?|displays?)\b|意思是|表示|状态码|返回码|意味着|所谓|这(?:句|行|条)", re.I),
}
SPEAKS["notice"] = SPEAKS["error"]
#: A sentence that speaks of a thing is at least so much longer than it (parameter: share of the sentence's characters).
CITED = 0.5


@lru_cache(None)
def _needed():
    """One automaton over all words of NEEDS; a word's value is the kinds that need it."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in {w for words in NEEDS.values() for w in words}:
        a.add_word(w, tuple(k for k, words in NEEDS.items() if w in words))
    a.make_automaton()
    return a


def _cited(kind: str, text: str, start: int, end: int, density: float) -> bool:
    """Whether the sentence around a match only speaks of it: a word says so, and the match is the smaller part
    of the sentence and of the text."""
    cue = SPEAKS.get(kind)
    if cue is None or density >= CITED:
        return False
    head = max(text.rfind(c, 0, start) for c in "。!?！？\n") + 1
    tail = min((i for i in (text.find(c, end) for c in "。!?！？\n") if i >= 0), default=len(text))
    around = text[head:start] + " " + text[end:tail]
    return (end - start) < CITED * (tail - head) and bool(cue.search(around))


def repeats(texts: list[str]) -> np.ndarray:
    """Which texts may hold an ideograph five times or two to six of them three times in a row."""
    cps, offsets = code_points(texts)
    cps = cps.astype(np.int64)
    han = (cps >= 0x4E00) & (cps <= 0x9FFF)
    out = np.zeros(len(texts), bool)
    for k in range(1, 7):
        same = np.zeros(len(cps) + 1, np.int64)
        if len(cps) > k:
            same[1 : len(cps) - k + 1] = (cps[k:] == cps[:-k]) & han[k:]
        need = 4 if k == 1 else 2 * k
        total = np.cumsum(same)
        if len(total) > need:
            at = np.flatnonzero(total[need:] - total[:-need] == need)
            out[np.searchsorted(offsets, at, "right") - 1] = True
    return out


def residue(text: str, again: bool | None = None) -> dict[str, int]:
    """kind -> characters of residue in a text in its one form; empty for ordinary content.

    again: whether repeats() names the text; without it that is found out here.
    """
    low = text.lower()
    if again is None:
        again = bool(repeats([text])[0])
    met = {kind for _, kinds in _needed().iter(low) for kind in kinds}
    kinds = [k for k in KINDS if k in met or k == "filler" and again or k == "field" and _OPENS.search(low)]
    masked = text
    if "`" in text or "~~~" in text or "    " in text or "\t" in text:
        masked = CODE.sub(lambda m: " " * len(m.group()), text)
    bare = masked.strip()
    if not (bare[:1] in "“\"「『‘" and QUOTED.fullmatch(bare)):
        masked = QUOTED.sub(lambda m: "”" * len(m.group()), masked)
    out: dict[str, int] = {}
    for kind in kinds:
        found = list(KINDS[kind].finditer(masked))
        if found:
            density = sum(m.end() - m.start() for m in found) / max(1, len(bare))
            n = sum(m.end() - m.start() for m in found if not _cited(kind, masked, m.start(), m.end(), density))
            if n:
                out[kind] = n
    for line in masked.split("\n"):
        bare = MARKUP.sub("", line).strip()
        if not bare:
            continue
        for part in {bare, *_ENDS.split(bare)}:
            if part and (len(part) <= 60 and ALONE.fullmatch(part) or ALONE_WORD.search(part)):
                out["filler"] = out.get("filler", 0) + len(part)
                break
    return out


def residue_records(records: DataFrame) -> DataFrame:
    """(name, key, kinds, density) of records(name, key, text) that hold residue as content.

    kinds is sorted and joined with commas; density is the share of the text's characters in residue.
    Null keys and null, empty or ordinary texts give no row; repeated rows give repeated rows.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = []
            texts = canonical(p["text"])
            for name, key, text, again in zip(p["name"], p["key"], texts, repeats(texts)):
                found = residue(text, bool(again))
                if found:
                    rows.append((name, key, ",".join(sorted(found)), min(1.0, sum(found.values()) / max(1, len(text)))))
            yield pd.DataFrame(rows, columns=["name", "key", "kinds", "density"])

    return records.where("key is not null and text is not null").select("name", "key", "text").mapInPandas(run, "name string, key string, kinds string, density double")
