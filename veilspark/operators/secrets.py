"""Secret layer: credential rules, allowlist, placement in the text."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.checks import entropy_of
from veilspark.functions.rowsql import column, each, each_at, empty, keep, let, lit, struct
from veilspark.functions.spans import spans_of
from veilspark.functions.text import A_END, A_START
from veilspark.operators.rules import any_of, guard
from veilspark.schema import NO_FINDINGS, SECRET, finding

SECRET_SCORE = 1.0


@dataclass(frozen=True)
class SecretRule:
    """A credential pattern. The secret is capture group `group`; `min_entropy`
    and `allow` (regexes on the secret) drop look-alikes. `literals`, `folded`
    (literals without case, given in lower case) and `hint` are cheap tests on the
    text."""

    name: str
    pattern: str
    group: int = 1
    description: str | None = None
    min_entropy: float = 0.0
    allow: tuple[str, ...] = ()
    literals: tuple[str, ...] = ()
    folded: tuple[str, ...] = ()
    hint: str | None = None


_KEY = r"(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|wachtwoord)"
_KEY_WORDS = ("pass", "pwd", "secret", "token", "key", "wachtwoord")

# Rules written from the published description of what each one finds.
CUSTOM_RULES = (
    SecretRule(
        "buffer-from-credential",
        r"""Buffer\.from\(\s*["'`]([^"'`\r\n]{6,})["'`]""",
        description="Credential inside Buffer.from()",
        literals=("Buffer.from",),
    ),
    SecretRule(
        "basic-auth-header",
        A_START + r"(?i:basic)\s+([A-Za-z0-9+/]{10,}={0,2})(?![A-Za-z0-9+/=])",
        description="Basic authorization header with an encoded credential",
        allow=(r"^[a-z]+$", r"^[A-Z]?[a-z]+$"),
        folded=("basic",),
    ),
    SecretRule(
        "quoted-secret-assignment",
        r"(?i)" + _KEY + r"""["']?\s*(?:=>|:=|[:=])\s*["']([^"'\s]{8,})["']""",
        description="Password or secret in a quoted assignment",
        folded=_KEY_WORDS,
        hint=r"""[=:>]\s*["']""",
    ),
    SecretRule(
        "plain-text-credential",
        A_START
        + r"""(?i:login|password|username|wachtwoord|gebruikersnaam)(?:\s*:\s*|\s+(?i:is\s+)?)([^\s"'`,;:=<>(){}\[\]]{6,})""",
        description="Login, password or user name followed by its value",
        # plain words and placeholders are no credentials
        allow=(r"^\p{L}+[.!?]?$", r"^\p{L}+(?:-\p{L}+)+$", r"^[\p{L}_]+$"),
        folded=("login", "password", "username", "wachtwoord", "gebruikersnaam"),
    ),
    SecretRule(
        "unquoted-credential",
        r"(?i)" + _KEY + r"""[a-z0-9_]{0,32}=([^\s"'`&;,<>]{8,})""",
        description="Unquoted key=value credential",
        literals=("=",),
        folded=_KEY_WORDS,
        hint=r"[A-Za-z0-9_]=[^\s]",
    ),
    SecretRule(
        "workflow-credential-reference",
        r""""credentials"\s*:\s*\{\s*"[^"]*"\s*:\s*\{[^{}]*?"id"\s*:\s*"([^"]+)\"""",
        description="Workflow credential reference with an embedded id",
        literals=('"credentials"',),
    ),
    SecretRule(
        "hex-json-value",
        r""":\s*"([0-9a-fA-F]{32,})\"""",
        description="High-entropy hex string in a JSON value",
        min_entropy=3.0,
        literals=('"',),
        hint=r'"[0-9a-fA-F]{32}',
    ),
    SecretRule(
        "curl-credential",
        A_START + r"""curl(?=\s)[^\r\n]*?\s(?:-u|--user)[ =]+["']?([^\s"':]+:[^\s"']+)""",
        description="Credential on a curl command line",
        literals=("curl",),
        hint=r"-u|--user",
    ),
)

# Publicly documented credential formats.
DEFAULT_RULES = (
    SecretRule("cloud-access-key", A_START + r"((?:AKIA|ASIA|ABIA|ACCA)[A-Z2-7]{16})" + A_END, literals=("AKIA", "ASIA", "ABIA", "ACCA")),
    SecretRule("vcs-token", A_START + r"(gh[pousr]_[0-9A-Za-z]{36})", literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    SecretRule("vcs-fine-grained-token", A_START + r"(github_pat_[0-9A-Za-z_]{82})", literals=("github_pat_",)),
    SecretRule("ci-access-token", A_START + r"(glpat-[0-9A-Za-z_-]{20})", literals=("glpat-",)),
    SecretRule("chat-token", A_START + r"(xox[abeoprs]-[0-9A-Za-z-]{10,})", literals=("xox",)),
    SecretRule("payment-key", A_START + r"((?:sk|rk)_(?:test|live|prod)_[0-9A-Za-z]{10,99})" + A_END, literals=("k_test_", "k_live_", "k_prod_")),
    SecretRule("maps-api-key", A_START + r"(AIza[0-9A-Za-z_-]{35})" + r"(?![0-9A-Za-z_-])", literals=("AIza",)),
    SecretRule(
        "json-web-token",
        A_START + r"(ey[0-9A-Za-z_-]{17,}\.ey[0-9A-Za-z/_-]{17,}\.[0-9A-Za-z/_-]{10,}={0,2})",
        literals=(".ey",),
    ),
    SecretRule(
        "private-key",
        r"(?i:(-----BEGIN[ A-Z0-9_-]{0,100}PRIVATE KEY(?: BLOCK)?-----[\s\S]{64,}?KEY(?: BLOCK)?-----))",
        folded=("-----begin",),
    ),
)

SECRET_RULES = CUSTOM_RULES + DEFAULT_RULES

# Placeholders that are never a secret.
ALLOWED_VALUES = (
    r"(?i)^(?:x{4,}|\*{3,}|\.{3,}|<[^>]*>|\$\{[^}]*\}|\{\{.*\}\}|%[a-z_]+%)$",
    r"(?i)^(?:your[-_].*|example.*|placeholder.*|changeme.*|dummy.*|redacted.*|\[redacted.*)$",
    r"(?i)^(?:null|none|undefined|true|false)$",
)
# Folders and files that a caller may leave out of the secret layer (`allowed_paths`).
ALLOWED_PATHS = (
    r"(?:^|/)node_modules/",
    r"(?:^|/)\.git/",
    r"(?:^|/)package-lock\.json$",
    r"(?:^|/)(?:\.cache|__pycache__|cache)/",
)


def allowed_path(path: Column, patterns: Iterable[str] = ALLOWED_PATHS) -> Column:
    return F.coalesce(path.rlike(_alternatives(patterns)), F.lit(False))


def _alternatives(patterns: Iterable[str]) -> str:
    """One alternation instead of one test per pattern."""
    return "|".join(f"(?:{p})" for p in patterns)


def _reports(text: str, rules: list[SecretRule], allow: tuple[str, ...]) -> str:
    """array<struct<rule,description,secret>> in rule order, then text order;
    duplicates kept. Allowlisted and low-entropy matches are dropped."""

    def reported(rule: SecretRule, lowered: str) -> str:
        def wanted(s: str) -> str:
            tests = [f"{s} <> ''"]
            if allow or rule.allow:
                tests.append(f"NOT {s} RLIKE {lit(_alternatives((*allow, *rule.allow)))}")
            if rule.min_entropy > 0:
                tests.append(f"{entropy_of(s)} >= {rule.min_entropy}D")
            return " AND ".join(tests)

        found = keep(f"regexp_extract_all({text}, {lit(rule.pattern)}, {rule.group})", wanted)
        folded = [any_of(lowered, rule.folded)] if rule.folded else []
        return (
            f"CASE WHEN {guard(text, rule.literals, rule.hint, *folded)} THEN "
            + each(found, lambda s: struct(rule=lit(rule.name), description=lit(rule.description), secret=s))
            + f" ELSE {empty(_REPORT)} END"
        )

    if not rules:
        return empty(_REPORT)
    return let(f"lower({text})", lambda low: f"concat({', '.join(reported(r, low) for r in rules)})")


_REPORT = "struct<rule:string,description:string,secret:string>"


def _longest_first(reports: str) -> str:
    keyed = each_at(reports, lambda r, i: struct(n=f"-length({r}.secret)", ord=i, r=r))
    return each(f"array_sort({keyed})", lambda k: f"{k}.r")


def _place(r: str, start: str) -> str:
    return finding(
        start, f"{start} + length({r}.secret)", f"{SECRET_SCORE}D", lit(SECRET), f"{r}.rule", f"{r}.secret",
        f"coalesce({r}.description, {r}.rule)",
    )


def locate_sql(text: str, reports: str, all_occurrences: bool = False) -> str:
    """SQL of `locate_secrets`."""

    def first_only(rs: str) -> str:
        placed = each(_longest_first(rs), lambda r: let(f"instr({text}, {r}.secret) - 1", lambda at: _place(r, at)))
        return keep(placed, lambda f: f"{f}.start >= 0")

    def everywhere(rs: str) -> str:
        def places(r: str) -> str:
            return each(spans_of(text, quoted_sql(f"{r}.secret")), lambda s: _place(r, f"{s}.start"))

        return f"flatten({each(_longest_first(f'array_distinct({rs})'), places)})"

    body = everywhere if all_occurrences else first_only
    return let(reports, lambda rs: f"CASE WHEN size({rs}) > 0 THEN {body(rs)} ELSE {NO_FINDINGS} END")


def locate_secrets(text: Column, reports: Column, all_occurrences: bool = False) -> Column:
    """Place reported secrets in the text.

    `reports` is array<struct<rule,description,secret>>. Longest secret first;
    each report maps to the first place of its secret in the text, and one that
    is not found is dropped. Repeats are kept and counted. With
    `all_occurrences`, every place of every distinct secret is a finding.
    """
    return column(lambda t, r: locate_sql(t, r, all_occurrences), t=text, r=reports)


def quoted_sql(value: str) -> str:
    """SQL: regex that matches `value` literally."""
    begin, end = r"\Q", r"\E"
    return f"concat({lit(begin)}, replace({value}, {lit(end)}, {lit(end + chr(92) + end + begin)}), {lit(end)})"


def secrets_sql(text: str, rules: Iterable[SecretRule], allow: Iterable[str], all_occurrences: bool = False) -> str:
    return locate_sql(text, _reports(text, list(rules), tuple(allow)), all_occurrences)


def detect_secrets(
    text: Column,
    rules: Iterable[SecretRule] = SECRET_RULES,
    allow: Iterable[str] = ALLOWED_VALUES,
    all_occurrences: bool = False,
    path: Column | None = None,
    allowed_paths: Iterable[str] = (),
) -> Column:
    """The secret layer of one text; NULL, as a layer that did not run, where the path is on the given allowlist."""
    rules, allow = list(rules), tuple(allow)
    found = column(lambda t: secrets_sql(t, rules, allow, all_occurrences), t=text)
    allowed_paths = tuple(allowed_paths)
    return F.when(~allowed_path(path, allowed_paths), found) if path is not None and allowed_paths else found
