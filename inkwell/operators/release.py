"""Release audit: which files of an inventory may be published, and why not.

A file's rules have an order in which a fatal one hides the later ones; it is one expression per file,
so the audit is a single pass over paths and contents, without a shuffle but for path collisions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.udfs import casefold, nfc
from inkwell.operators.audit import text_rules

# Message of each code, names that systems reserve, signs that file systems refuse,
# components that may begin with a dot.
MESSAGES = {
    "absolute_path": "absolute path", "binary_file": "binary file", "config_invalid": "unsafe policy", "file_too_large": "file too large", "forbidden_extension": "forbidden extension",
    "forbidden_path": "path outside the allowlist", "identity_pattern": "mail address", "invalid_git_mode": "invalid mode", "invalid_path": "path that is not portable", "lfs_pointer": "pointer to a large file",
    "local_identity": "name of host or user", "missing_tracked_file": "listed file is missing", "private_term": "private term", "secret_pattern": "secret", "tracked_submodule": "submodule", "tracked_symlink": "symbolic link",
    "unsafe_remote": "remote that is not allowed", "worktree_mismatch": "worktree differs from index",
}
RESERVED = ["CLOCK$", "CON", "CONIN$", "CONOUT$", "PRN", "AUX", "NUL", *[f"{p}{n}" for p in ("COM", "LPT") for n in "123456789¹²³"]]
DOTTED = [".codebuddy", ".gitattributes", ".github", ".gitignore"]
POINTER = "version https://git-lfs.github.com/spec/v1"
UNSAFE, REDACTED = "<unsafe-path>", "<redacted-path>"


@dataclass(frozen=True)
class Policy:
    """What may be published; a policy read from outside may only narrow the built-in one (is_narrower)."""

    directories: list[str] = field(default_factory=lambda: [".github", "config", "docs", "scripts", "src", "templates", "tests"])
    example: str = "examples/public"
    root_files: list[str] = field(default_factory=lambda: [".gitignore", "LICENSE", "NOTICE", "pyproject.toml"])
    forbidden_directories: list[str] = field(default_factory=lambda: [".venv", "__pycache__", "build", "dist", "node_modules", "private"])
    forbidden_extensions: list[str] = field(default_factory=lambda: [".doc", ".docx", ".pdf", ".png", ".jpg", ".zip", ".mp3", ".mp4", ".db"])
    max_bytes: int = 2 * 1024 * 1024
    terms: list[str] = field(default_factory=list)
    contacts: list[str] = field(default_factory=list)

    def is_narrower(self, base: Policy) -> bool:
        more = lambda a, b: set(map(str.casefold, a)) >= set(map(str.casefold, b))
        fewer = lambda a, b: set(a) <= set(b)
        return fewer(self.directories, base.directories) and fewer(self.root_files, base.root_files) and self.example == base.example and more(self.forbidden_directories, base.forbidden_directories) and more(self.forbidden_extensions, base.forbidden_extensions) and 0 < self.max_bytes <= base.max_bytes


def is_portable(path: Column, composed: Column) -> Column:
    """Whether a relative path is safe on any system; composed: its NFC form. Null is not."""
    parts = F.split(path, "/")
    stem = lambda p: F.upper(F.regexp_extract(p, r"^([^.]*)", 1))
    ok = lambda p: p.isin(DOTTED) | (~p.rlike(r"^[ .]|[ .]$|[<>:\"|?*]") & ~stem(p).isin(RESERVED) & (p != ""))
    return F.coalesce((path != "") & ~path.rlike(r"[\\\p{Cf}\x00-\x1f\x7f]|^[A-Za-z]:") & (composed == path) & F.forall(parts, ok), F.lit(False))


def is_allowed(path: Column, policy: Policy) -> Column:
    """Whether a path is in the policy's allowlist; no component may be forbidden, whatever its case."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: F.lower(p).isin([d.lower() for d in policy.forbidden_directories]) | F.lower(p).endswith(".egg-info"))
    root = path.isin(policy.root_files) | path.rlike(r"^README(?:\.[A-Za-z0-9_-]+)?\.md$")
    top = F.get(parts, F.lit(0))
    return ~bad & F.when(F.size(parts) == 1, root).when(top == "examples", path.startswith(policy.example + "/")).otherwise(top.isin(policy.directories))


def file_codes(policy: Policy, hosts: list[str] = (), users: list[str] = ()) -> Column:
    """Codes of a file(path, mode, size, content, missing) in their order; a fatal rule ends the list.

    content is binary and may be null for a file that is too large: the size is tested first, so that no
    such content need be read.
    """
    path, mode, content = F.col("path"), F.col("mode"), F.col("content")
    suffix = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))
    text = F.try_validate_utf8(content.cast("string"))
    none = F.array().cast("array<string>")
    one = lambda c: F.array(F.lit(c))
    rules = text_rules(text, policy.terms, policy.contacts, hosts, users)
    scanned = F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(c)) for c, r in rules.items()]))
    rest = (
        F.when(mode == "120000", one("tracked_symlink")).when(mode == "160000", one("tracked_submodule")).when(~F.coalesce(mode.isin("100644", "100755"), F.lit(False)), one("invalid_git_mode"))
        .when(suffix.isin([e.lower() for e in policy.forbidden_extensions]), one("forbidden_extension")).when(F.coalesce(F.col("missing"), F.lit(False)), one("missing_tracked_file"))
        .when(F.col("size") > policy.max_bytes, one("file_too_large")).when(content.isNull(), none).when(F.contains(content, F.unhex(F.lit("00"))) | text.isNull(), one("binary_file"))
        .when(text.rlike(rf"^\Q{POINTER}\E\r?\n"), one("lfs_pointer")).otherwise(scanned)
    )
    return F.concat(F.when(is_allowed(path, policy), none).otherwise(one("forbidden_path")), rest)


def release_audit(files: DataFrame, policy: Policy, hosts: list[str] = (), users: list[str] = ()) -> DataFrame:
    """(level, code, path, message) of files(path, mode, size, content, missing, differs), unordered; issue_order sorts.

    A path that is not portable, or that meets another one but for case and composition, is reported as
    such only and hidden; a path that breaks a rule for texts is hidden in all its issues. A path that is
    listed twice has an invalid mode. differs: the worktree's content is another one (a warning).
    """
    d = files.withColumn("_nfc", nfc("path")).withColumn("_key", casefold(F.col("_nfc")))
    seen = d.groupBy("_key").agg(F.count_distinct("path").alias("_spellings"), F.min("path").alias("_first"))
    listed = d.groupBy("path").agg(F.count("*").alias("_times"))
    d = d.join(seen, "_key", "left").join(listed, "path", "left")
    odd = ~is_portable(F.col("path"), F.col("_nfc")) | ((F.col("_spellings") > 1) & (F.col("path") != F.col("_first")))
    own = text_rules(F.col("path"), policy.terms, policy.contacts, hosts, users)
    tells = F.lit(False)
    for r in own.values():
        tells = tells | F.coalesce(r, F.lit(False))
    codes = F.when(F.coalesce(odd, F.lit(True)), F.array(F.lit("invalid_path"))).when(F.col("_times") > 1, F.array(F.lit("invalid_git_mode"))).otherwise(file_codes(policy, hosts, users))
    warned = F.when(F.col("differs") & ~F.coalesce(odd, F.lit(True)), F.array(F.lit("worktree_mismatch"))).otherwise(F.array().cast("array<string>"))
    shown = F.when(F.coalesce(odd, F.lit(True)), UNSAFE).when(tells, REDACTED).otherwise(F.col("path"))
    out = d.select(shown.alias("path"), F.explode(F.array_distinct(F.concat(codes, warned))).alias("code")).distinct()
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return out.select(F.when(F.col("code") == "worktree_mismatch", "warning").otherwise("error").alias("level"), "code", "path", message[F.col("code")].alias("message"))


def inventory_entries(listed: DataFrame, staged: DataFrame) -> DataFrame:
    """(path, mode, oid, conflict): listed(path) with the one record at stage 0 of staged(path, mode, oid, stage).

    conflict: a path has no record, more than one, one at another stage, or stands in one of the two only.
    """
    a = listed.where("path is not null").groupBy("path").agg(F.lit(True).alias("_in"))
    b = staged.where("path is not null").groupBy("path").agg(F.count("*").alias("_n"), F.max("stage").alias("_stage"), F.min_by("mode", "stage").alias("mode"), F.min_by("oid", "stage").alias("oid"))
    d = a.join(b, "path", "full_outer")
    bad = F.col("_in").isNull() | F.col("_n").isNull() | (F.col("_n") != 1) | (F.col("_stage") != 0)
    return d.select("path", "mode", "oid", bad.alias("conflict"))


def unsafe_remotes(fetch: DataFrame, push: DataFrame, allowed: list[str]) -> DataFrame:
    """(url): distinct fetch and push addresses outside the allowed ones, local ones included."""
    u = fetch.select("url").unionByName(push.select("url")).where("url is not null").distinct()
    return u.where(~F.trim("url").isin(allowed) if allowed else F.lit(True))
