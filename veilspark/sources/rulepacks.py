"""Rule packs: credential rules, allowlists and left-out paths as data, from a TOML file.

    [allowlist]                      # for all rules
    regexes = ["..."]                # secrets that are none
    stopwords = ["..."]              # parts of secrets that are none
    paths = ["..."]                  # files that the secret layer leaves out

    [[rules]]
    id = "..."
    regex = "..."
    description = "..."              # the rest is optional
    secretGroup = 1                  # default: the first group, or the whole match without one
    entropy = 3.0                    # least bits per character
    keywords = ["..."]               # the text holds one of these, in any case
    allowlist = { regexes = [], stopwords = [] }

Patterns are in the linear-time dialect that such files use; `java_pattern` puts them into that
of the JVM with the same matches, and refuses what has none. A field that would change results
and is not known is refused too, not left out.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

from veilspark.operators.secrets import SecretRule

#: Public formats that the package brings.
FORMATS = Path(__file__).with_name("formats.toml")

_WORD, _SPACE = "[0-9A-Za-z_]", r"\t\n\f\r "
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_EDGE = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_OUTSIDE = {"b": _EDGE, "B": _NO_EDGE, "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]", "v": r"\x0B"}
_INSIDE = {"s": _SPACE, "S": f"[^{_SPACE}]", "v": r"\x0B"}
_SAME = set("dDwWtnrfaAzx01234567")
#: POSIX classes and their names on the JVM.
_POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}
_RULE_FIELDS = {"id", "regex", "description", "secretGroup", "entropy", "keywords", "allowlist", "allowlists", "tags"}
_ALLOW_FIELDS = {"description", "regexes", "stopwords", "regexTarget"}


@dataclass(frozen=True)
class RulePack:
    """What a rule file says; the fields go to ScanOptions(secret_rules, allowed_values, allowed_paths)."""

    rules: tuple[SecretRule, ...]
    allow: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()


def java_pattern(pattern: str) -> tuple[str, int]:
    """The pattern for the JVM, and its number of groups. Only line feeds end lines, as in the other dialect."""
    out, groups, at, inside = [], 0, 0, False
    lines = re.search(r"\(\?[a-z]*m", pattern) is not None
    while at < len(pattern):
        ch, rest = pattern[at], pattern[at:]
        size = 1
        if ch == "\\":
            text, size = _escape(rest, inside, pattern)
            out.append(text)
        elif inside:
            if posix := re.match(r"\[:(\^?)(\w+):\]", rest):
                if posix[2] != "word" and posix[2] not in _POSIX:
                    raise ValueError(f"unknown class {posix[0]} in {pattern}")
                negative = "P" if posix[1] else "p"
                word = r"\W" if posix[1] else r"\w"
                out.append(word if posix[2] == "word" else f"\\{negative}{{{_POSIX[posix[2]]}}}")
                size = len(posix[0])
            else:
                inside = ch != "]"
                # these two nest and intersect classes on the JVM
                out.append(f"\\{ch}" if ch in "[&" else ch)
        elif ch == "[":
            begin = re.match(r"\[\^?\]?", rest)[0]
            out.append(begin.replace("]", r"\]"))
            size, inside = len(begin), True
        elif ch == "(":
            named = re.match(r"\(\?P?<([A-Za-z_]\w*)>", rest)
            flags = re.match(r"\(\?([a-zA-Z-]*)[:)]", rest)
            if flags and not set(flags[1]) <= set("ims-"):
                raise ValueError(f"flags {flags[1]} are not supported: {pattern}")
            if rest.startswith("(?") and not (named or flags):
                raise ValueError(f"unknown group in {pattern}")
            groups += named is not None or not flags
            out.append(f"(?<g{groups}>" if named else "(")
            size = len(named[0]) if named else 1
        else:
            out.append(r"\z" if ch == "$" and not lines else ch)
        at += size
    return "(?d)" + "".join(out), groups


def _escape(rest: str, inside: bool, pattern: str) -> tuple[str, int]:
    """The JVM's form of the escape that rest begins with, and its length."""
    if quoted := re.match(r"\\Q(.*?)(?:\\E|\Z)", rest, re.DOTALL):
        return re.sub(r"([^0-9A-Za-z_\s])", r"\\\1", quoted[1]), len(quoted[0])
    if named := re.match(r"\\[pPx](?:\{[^}]*\}|[0-9A-Fa-f]{2}|[A-Z])", rest):
        return named[0], len(named[0])
    ch = rest[1:2]
    text = (_INSIDE if inside else _OUTSIDE).get(ch)
    if text is None:
        if not ch or ch.isalnum() and ch not in _SAME:
            raise ValueError(f"\\{ch} is not supported: {pattern}")
        text = "\\" + ch
    return text, 2


def _allowed(lists: Iterable[dict], fields: set[str]) -> list[str]:
    out = []
    for given in lists:
        if odd := given.keys() - fields:
            raise ValueError(f"allowlist fields are not supported: {sorted(odd)}")
        if given.get("regexTarget", "secret") != "secret":
            raise ValueError("allowlists are tested on the secret only")
        out += [java_pattern(r)[0] for r in given.get("regexes", ())]
        out += ["(?i)" + java_pattern(rf"\Q{w}\E")[0] for w in given.get("stopwords", ())]
    return out


def _lists(given: dict) -> list[dict]:
    own = given.get("allowlist", [])
    return [*(own if isinstance(own, list) else [own]), *given.get("allowlists", [])]


def _rule(given: dict) -> SecretRule:
    if odd := given.keys() - _RULE_FIELDS:
        raise ValueError(f"rule fields are not supported: {sorted(odd)}")
    pattern, groups = java_pattern(given["regex"])
    group = given.get("secretGroup", min(1, groups))
    if not 0 <= group <= groups:
        raise ValueError(f"{given['id']} has no group {group}")
    return SecretRule(
        given["id"], pattern, group, given.get("description"), float(given.get("entropy", 0.0)),
        tuple(_allowed(_lists(given), _ALLOW_FIELDS)), folded=tuple(w.lower() for w in given.get("keywords", ())),
    )


def parse_pack(text: str) -> RulePack:
    """The pack of a rule file's text; rules keep their order, ids must differ."""
    given = tomllib.loads(text)
    if odd := given.keys() - {"title", "description", "allowlist", "allowlists", "rules"}:
        raise ValueError(f"fields are not supported: {sorted(odd)}")
    rules = tuple(_rule(r) for r in given.get("rules", ()))
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("two rules have the same id")
    lists = _lists(given)
    paths = tuple(java_pattern(p)[0] for one in lists for p in one.get("paths", ()))
    return RulePack(rules, tuple(_allowed(lists, _ALLOW_FIELDS | {"paths"})), paths)


def read_pack(spark: SparkSession, path: str) -> RulePack:
    """The pack of a file on any file system that Spark reads."""
    return parse_pack(spark.read.text(path, wholetext=True).first().value)


@lru_cache(maxsize=1)
def format_pack() -> RulePack:
    """Public formats of keys and tokens, beside secrets.DEFAULT_RULES."""
    return parse_pack(FORMATS.read_text())
