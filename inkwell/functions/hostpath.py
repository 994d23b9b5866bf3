"""Whether a text names a path of some host, as built-in expressions: no row leaves the JVM.

The text's links are taken out with regexp_extract_all and judged one by one; web addresses, stand-ins
such as <root>/x and links to public places are blanked; one pattern with an alternative per kind of
path then tests what is left. Percent-decoding is a fold over a fixed number of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories at the root of a file system, and first components of links inside a site.
ROOTS = ["Applications", "Library", "Users", "Volumes", "data", "etc", "home", "mnt", "opt", "private", "root", "srv", "tmp", "usr", "var", "workspace"]
PUBLIC = [".codebuddy", ".github", "agent-guides", "config", "docs", "knowledge", "scripts", "src", "templates", "tests", "api", "assets", "help", "images", "static"]
PUBLIC_FILES = r"README(?:\.[A-Za-z0-9_-]+)?\.md|LICENSE(?:\.md)?|NOTICE(?:\.md)?|(?:CHANGELOG|CONTRIBUTING|SECURITY)\.md"
SYSTEM = r"bin/+(?:bash|sh)|usr/+bin"
FIELDS = "source|path|file|locator|location|at|位于|路径|来源"
ROUNDS = 4

_ANY = "|".join(ROOTS)
_STOP = r"\s'\"<>()\[\]{}"
_WORD = r"\p{L}\p{N}_"
_HOST = r"(?:[^\s<>\"'/?#@]*@)?(?:[A-Za-z0-9.-]+|\[[A-Fa-f0-9:]+\])(?::\d*)?"
_ADDRESS = rf"(?i)(?<![{_WORD}])https?://{_HOST}(?![^\s<>\"'/?#.,;!?)\]}}])[^\s<>\"']*"
_STAND_IN = r"<[A-Za-z][A-Za-z0-9_-]*>/[A-Za-z0-9._~+/-]+"
_LINK = r"!?\[[^\]\r\n]*\]\([ \t]*(<[^<>\r\n]*>|[^\s()<>]+)(?:[ \t]+(?:\"[^\"\r\n]*\"|'[^'\r\n]*'|\([^()\r\n]*\)))?[ \t]*\)"
_SCHEME = r"file:[\\/]"
_DRIVE = r"(?<![A-Za-z0-9])[A-Za-z]:[\\/]"
_ENDS = rf"(?=/|[.,;:!?]*(?:$|[{_STOP}]))"
#: A path of a host in running text, one alternative per kind.
_NAMED = "|".join(
    [
        rf"(?i:{_SCHEME})",
        r"(?<![A-Za-z0-9\\])[A-Za-z]:[\\/]",
        r"(?<!\\)\\\\[A-Za-z0-9][A-Za-z0-9._-]*\\[^\\\s]",
        r"(?<![:/])//[A-Za-z0-9._-]+/[A-Za-z0-9._~-]",
        rf"(?<![{_WORD}:/.-])/(?!/)(?!(?:{SYSTEM}){_ENDS})(?=[A-Za-z0-9_\x{{3400}}-\x{{9fff}}.~+-])"
        + "(?:"
        + "|".join(
            [
                rf"(?:{_ANY}){_ENDS}",
                rf"[^{_STOP}/]+/+[^{_STOP}]*?[^{_STOP}/.,;:!?]",
                rf"[^{_STOP}]*\\",
                rf"(?<=(?:(?i:{FIELDS})\s{{0,9}}[:=]?\s{{0,9}}|\]\(\s{{0,9}}|[>]\s{{0,9}}|[<]\s{{0,9}})/)[^{_STOP}]*?[^{_STOP}/.,;:!?]",
            ]
        )
        + ")",
    ]
)


def _dangerous(v: Column) -> Column:
    """A backslash, a control or format character, or a letter with a loose accent (not composed)."""
    return v.rlike(r"[\\\p{Cc}\p{Cf}]|[A-Za-z\p{IsLatin}][\x{300}-\x{36f}]")


def _broken(v: Column) -> Column:
    return v.rlike(r"%(?![0-9A-Fa-f]{2})")


def _once(v: Column) -> Column:
    """One round of decoding; null where the bytes are no UTF-8. A plus sign stays one."""
    out = F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))
    return F.when(out.contains("\ufffd") & ~v.rlike("\ufffd|(?i)%EF%BF%BD"), None).otherwise(out)


def settled(v: Column, safe) -> Column:
    """v percent-decoded until it no longer changes, at most ROUNDS times; null where it still does,
    or where a value on the way is not safe(value)."""
    step = lambda a, _: F.when(safe(a), _once(a))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), v, step)
    return F.when(safe(last) & (_once(last) == last), last)


def percent_decoded(v: Column) -> Column:
    """Percent-decoding to a fixed point; null for broken escapes, bytes that are no UTF-8, control and
    format characters, and values that still change after the last round. Null stays null."""
    return settled(v, lambda x: ~_broken(x) & ~x.rlike(r"[\p{Cc}\p{Cf}]"))


def _host(v: Column) -> Column:
    return v.rlike(rf"(?<![A-Za-z])(?i:{_SCHEME})|{_DRIVE}|(?<!:)//[A-Za-z0-9._-]+(?:/|$)")


def _safe_target(v: Column) -> Column:
    """Whether a link's target, decoded this far, names nothing outside its site."""
    climbs = r"(?:^|[/=?#&])\.\.(?:[/=?#&]|$)"
    hidden = rf"(?i)(?:^|[=?#&])/(?:{_ANY})(?:/|$)"
    inner = r"[?#](?:.*[=&])?/(?!/)[^\s&#]"
    return ~(_broken(v) | v.startswith("//") | _dangerous(v) | _host(v) | v.rlike(f"{climbs}|{hidden}|{inner}"))


def _public(v: Column, example: str) -> Column:
    """Whether a target that begins with a slash is a public place of the site."""
    path = F.regexp_extract(v, r"^([^?#]*)", 1)
    places = "|".join([rf"(?:{'|'.join(map(_quoted, PUBLIC))})(?:/.*)?", rf"{_quoted(example)}(?:/.*)?", PUBLIC_FILES])
    return _safe_target(v) & path.rlike(rf"^/(?:{places})$") & ~path.rlike(r"//|/\.{1,2}(?:/|$)|/$")


def _quoted(s: str) -> str:
    return s.replace(".", r"\.")


def link_state(target: Column, example: str) -> Column:
    """'unsafe' (names a path of a host), 'public' (may be blanked) or 'plain' of a link's target."""
    angle = target.startswith("<")
    v = F.when(angle, F.regexp_replace(target, "^<|>$", "")).otherwise(target)
    web = v.rlike(rf"^(?i:https?://){_HOST}(?:[/?#]|$)")
    rest = F.regexp_replace(v, r"^(?i:https?://)[^/?#]*", "")
    pieces = F.split(rest, r"[?#]")
    wrong = F.exists(pieces, lambda x: settled(x, lambda a: ~_broken(a) & ~_dangerous(a) & ~a.rlike(r"(?:^|/)\.\.(?:/|$)")).isNull())
    plain = F.when(v.contains("%"), settled(v, _safe_target)).otherwise(v)
    climbed = ~v.startswith("/") & plain.startswith("/")
    unsafe = plain.isNull() | (angle & _dangerous(v)) | _host(plain) | climbed | (plain.startswith("/") & ~_public(plain, example))
    kept = F.when(v.rlike(r"\s"), "plain").otherwise("public")
    own = F.when(unsafe, "unsafe").when(plain.startswith("/"), kept).otherwise("plain")
    return F.when(angle & (v == ""), "plain").when(web, F.when(wrong, "unsafe").otherwise(kept)).otherwise(own)


def names_host_path(text: Column, example: str = "examples/public") -> Column:
    """Whether a text names an absolute path of some host; null stays null.

    Web addresses, stand-ins like <root>/x and links to public places of the site (`example` is the one
    directory of examples among them) don't count.
    """
    links = F.transform(F.regexp_extract_all(text, F.lit(_LINK), F.lit(1)), lambda t: F.struct(t.alias("t"), link_state(t, example).alias("s")))
    public = F.transform(F.filter(links, lambda x: x["s"] == "public"), lambda x: x["t"])
    tight = F.regexp_replace(text, r"\]\([ \t]*", "](")
    blank = F.aggregate(public, tight, lambda t, p: F.replace(t, F.concat(F.lit("]("), p), F.lit("](")))
    blank = F.regexp_replace(F.regexp_replace(blank, _ADDRESS, " "), _STAND_IN, " ")
    found = F.exists(links, lambda x: x["s"] == "unsafe") | blank.rlike(_NAMED)
    return F.when(text.isNull(), None).when(~text.rlike(r"[/\\%]"), False).otherwise(found)
