"""Text functions: names, paths, providers, remotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Providers that another one bills, and prefixes of models that name their provider.
BILLED_BY = {
    "openai-codex": "openai",
    "github-copilot": "github",
    "claude-bridge": "anthropic",
    "google-gemini-cli": "google",
    "google-antigravity": "google",
    "deepseek-official": "deepseek",
    "kimi-coding": "moonshot",
}
MODEL_OWNERS = [("^gpt-", "openai"), ("^o[134]($|[-.])", "openai"), ("^claude($|[-.])", "anthropic"), ("^gemini($|[-.])", "google")]
UNATTRIBUTED = "(unattributed)"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def without_control(c: Column) -> Column:
    """Without C0, C1 and bidirectional control characters."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f\x{061C}\x{200E}\x{200F}\x{2028}-\x{202E}\x{2066}-\x{2069}]", "")


def model_name(c: Column) -> Column:
    return F.nullif(F.substring(F.lower(F.trim(without_control(c))), 1, 256), F.lit(""))


def billing_provider(c: Column) -> Column:
    """The provider that bills: known other names, then anything that starts with openai- or openai/."""
    p = F.lower(F.trim(c))
    out = F.when(c.isNull() | (p == ""), None)
    for name, owner in BILLED_BY.items():
        out = out.when(p == name, owner)
    return out.when(p.startswith("openai-") | p.startswith("openai/"), "openai").otherwise(p)


def provider_of_model(c: Column) -> Column:
    m = F.lower(F.trim(c))
    out = F.when(m.isNull(), None)
    for pattern, owner in MODEL_OWNERS:
        out = out.when(m.rlike(pattern), owner)
    return out


def without_end_separators(c: Column) -> Column:
    """Without separators at the end, except the one of a bare root."""
    return F.when(~(c.endswith("/") | c.endswith("\\")), c).otherwise(_without_end_separators(c))


def _without_end_separators(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^(?:([A-Za-z]:[/\\])[/\\]*|([/\\])[/\\]*|(.*?)[/\\]*)$", "$1$2$3")


def _above(c: Column, tail: str, separator: str = r"[/\\]") -> Column:
    """What stands before the first tail that runs to the end, a bare root with its separator."""
    return F.regexp_replace(c, rf"(?s)^(?:((?:[A-Za-z]:)?{separator})|(.*?){separator}){tail}$", "$1$2")


def project_key(root: Column) -> Column:
    """The project of a directory: what holds its node_modules, the repository of its agent worktree.

    Most directories are neither, and end in no separator: they are told without a pattern.
    """
    plain = ~(root.contains("node_modules") | root.contains(".claude") | root.endswith("/") | root.endswith("\\"))
    one = _above(_without_end_separators(root), r"node_modules(?:[/\\].*)?")
    two = _above(_above(one, r"\.claude/worktrees/[^/\\].*", "/"), r"\.claude\\worktrees\\[^/\\].*", r"\\")
    return F.when(plain, root).otherwise(_without_end_separators(two))


def parent_key(key: Column) -> Column:
    """The key of the directory above; null for a bare root or a key without a separator."""
    bare = key.rlike(r"^[/\\]$") | key.rlike(r"^[A-Za-z]:[/\\]$")
    head = F.regexp_extract(key, r"(?s)^(.*)[/\\][^/\\]*$", 1)
    parent = F.when(head.rlike("^([A-Za-z]:)?$"), F.concat(head, F.substring(key, F.char_length(head) + 1, F.lit(1)))).otherwise(_without_end_separators(head))
    return F.when(bare | ~key.rlike(r"[/\\]"), None).otherwise(parent)


def is_windows_key(key: Column) -> Column:
    """Whether a key is a drive's or a network share's path, whichever machine logged it."""
    return key.rlike(r"^(?:[A-Za-z]:[/\\]|\\\\)")


def comparable_key(key: Column) -> Column:
    """The form in which keys are compared: Windows paths in lower case with one separator, others as they are."""
    return F.when(is_windows_key(key), F.lower(F.translate(key, "/", "\\"))).otherwise(key)


def key_segments(key: Column) -> Column:
    """The names of a key's path, without the drive."""
    return F.filter(F.split(F.regexp_replace(key, "^[A-Za-z]:", ""), r"[/\\]"), lambda x: x != "")


def moved_below(key: Column, above: Column, target: Column) -> Column:
    """key, at or below `above`, at the same place below target, with target's separators where the systems differ."""
    below = F.substring(key, F.char_length(above) + 1, F.char_length(key))
    apart = is_windows_key(key) != is_windows_key(target)
    own = F.when(is_windows_key(target), F.translate(below, "/", "\\")).otherwise(F.translate(below, "\\", "/"))
    return F.concat(target, F.when(apart, own).otherwise(below))


def ancestors(key: Column) -> Column:
    """key and all keys above it, nearest first, with the separators it is written with; a root keeps its own."""
    parts = F.split(key, r"[/\\]")
    upto = lambda n: F.char_length(F.array_join(F.slice(parts, F.lit(1), n), "/"))
    prefix = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.substring(key, F.lit(1), upto(n)))
    named = F.transform(prefix, lambda p: F.when(p == "", F.substring(key, 1, 1)).when(p.rlike("^[A-Za-z]:$"), F.substring(key, 1, 3)).otherwise(p))
    return F.array_distinct(F.filter(named, lambda p: p != ""))


def git_remote(url: Column) -> Column:
    """host/path of a git remote in lower case, whatever its protocol, user, port or .git ending."""
    u = F.trim(url)
    scp = r"^(?:[^@/\s]+@)?([^:/\s]+):(?!//)([^\s]+)$"
    web = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/\s]*@)?([^:/\s]+)(?::[0-9]+)?/([^\s?#]+)"
    host = F.when(u.rlike(web), F.regexp_extract(u, web, 1)).when(u.rlike(scp), F.regexp_extract(u, scp, 1))
    path = F.when(u.rlike(web), F.regexp_extract(u, web, 2)).when(u.rlike(scp), F.regexp_extract(u, scp, 2))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"(?i)\.git$", ""), "^/+", "")
    return F.lower(F.concat(host, F.lit("/"), F.nullif(clean, F.lit(""))))


def csv_guard(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula, with an apostrophe before it."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def fuzzy_form(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
