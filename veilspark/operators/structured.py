"""Pattern layer: structured identifiers."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column

from veilspark.functions.checks import bsn_test, iban_test, luhn_test
from veilspark.functions.rowsql import each, keep, let
from veilspark.functions.text import W_BOUND, W_END, W_START
from veilspark.operators.admit import ENTITIES
from veilspark.operators.rules import Registry, Rule, detect
from veilspark.schema import PATTERN

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# Common endings of public domain names, in any case. A longer list is a
# parameter: PATTERN_RULES.register(url_bare(endings)).
TOP_DOMAINS = """
com net org edu gov mil int info biz name pro mobi io dev app ai co tv me cc shop store online site website web cloud tech
blog news page link live life world today agency studio design digital email group media network services solutions
support systems team tools work xyz club art bank care city company consulting finance health hosting legal
nl be de fr es eu uk it pt at ch dk se no fi pl cz sk hu ro bg gr ie lu lt lv ee hr si is tr ru ua us ca mx br ar cl
au nz jp cn kr in sg hk tw id th vn my ph za ng ke eg ma il ae sa frl amsterdam brussels gent vlaanderen
""".split()


def longest_valid_iban(match: str) -> str:
    """SQL: the longest prefix of whole blank-separated groups that is a valid
    IBAN; a following upper-case word may have been taken for a group."""

    def shortened(groups: str) -> str:
        prefixes = each(f"sequence(size({groups}), 1, -1)", lambda n: f"array_join(slice({groups}, 1, {n}), ' ')")
        return f"get({keep(prefixes, iban_test)}, 0)"

    return let(f"split({match}, ' ')", shortened)


# The three recognizers that are fully specified (patterns, scores,
# context words).
BSN = Rule(
    "BSN", r"\b[0-9]{9}\b", 0.3,
    context=("bsn", "burgerservicenummer", "sofinummer", "sofi"),
    check=bsn_test("value"), checked_score=0.85, digits=True, hint=r"[0-9]{9}",
)
KVK = Rule(
    "KVK_NUMBER", r"\b[0-9]{8}\b", 0.15,
    context=("kvk", "kamer van koophandel", "kvk-nummer", "handelsregister"),
    digits=True, hint=r"[0-9]{8}",
)
_NL_PHONE_CONTEXT = ("telefoon", "telefoonnummer", "mobiel", "bellen", "phone", "tel", "mobile")
NL_PHONE = (
    Rule("NL_PHONE_NUMBER", r"(?:\+31|0031)[\s\-]?[1-9][\s\-]?(?:[0-9][\s\-]?){7,8}", 0.7,
         context=_NL_PHONE_CONTEXT, literals=("+31", "0031"), name="NL_PHONE_INTL"),
    Rule("NL_PHONE_NUMBER", r"\b06[\s\-]?(?:[0-9][\s\-]?){8}\b", 0.7,
         context=_NL_PHONE_CONTEXT, literals=("06",), hint=r"06[\s\-]?(?:[0-9][\s\-]?){8}", name="NL_PHONE_MOBILE"),
    Rule("NL_PHONE_NUMBER", r"\b0[1-9][0-9][\s\-]?(?:[0-9][\s\-]?){6,7}\b", 0.5,
         context=_NL_PHONE_CONTEXT, digits=True, hint=r"0[1-9][0-9][\s\-]?(?:[0-9][\s\-]?){6}", name="NL_PHONE_LANDLINE"),
)

# White space as Python's `\s` sees it, for use inside a character class.
_SPACE = r"\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def unicode_form(pattern: str) -> str:
    """Java form of a Python pattern: Unicode word boundaries and white space.

    A leading boundary stands before a word character; a trailing one may follow
    a separator, so it needs the full two-sided test.
    """
    if pattern.startswith(r"\b"):
        pattern = W_START + pattern.removeprefix(r"\b")
    if pattern.endswith(r"\b"):
        pattern = pattern.removesuffix(r"\b") + W_BOUND
    return pattern.replace(r"[\s\-]", rf"[{_SPACE}\-]")


# Publicly known forms; scores are those of the public recognizers.
EMAIL = Rule(
    "EMAIL_ADDRESS",
    W_START + r"[\p{L}\p{N}_][\p{L}\p{M}\p{N}._%+&'\u2019\-]{0,63}@[\p{L}\p{M}\p{N}\-]{1,63}(?:\.[\p{L}\p{M}\p{N}\-]{1,63}){0,8}"
    r"\.(?:\p{L}[\p{L}\p{M}]{1,23}|xn--[A-Za-z0-9\-]{2,59})" + W_END,
    1.0,
    literals=("@",),
)
IBAN = Rule(
    "IBAN_CODE",
    W_START + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + W_END,
    1.0,
    refine=longest_valid_iban("value"),
    digits=True,
    hint=r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
)
CARD = Rule(
    "CREDIT_CARD",
    W_START + r"(?:4[0-9]{3}|5[0-5][0-9]{2}|6[0-9]{3}|1[0-9]{3}|3[0-9]{3})[- ]?[0-9]{3,4}[- ]?[0-9]{3,4}[- ]?[0-9]{3,5}" + W_END,
    1.0,
    check=luhn_test("value"),
    digits=True,
    hint=r"[0-9]{4}[- ]?[0-9]{3}",
)
IPV4 = Rule(
    "IP_ADDRESS", W_START + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + W_END, 0.6, digits=True, hint=r"[0-9]\.[0-9]{1,3}\.", name="IPV4"
)
IPV6 = Rule(
    "IP_ADDRESS",
    rf"(?<![\p{{L}}\p{{N}}_:.])(?:(?:(?:[0-9A-Fa-f]{{1,4}}:){{6}}|(?:[0-9A-Fa-f]{{1,4}}:){{1,5}}:(?:[0-9A-Fa-f]{{1,4}}:){{0,4}}"
    rf"|::(?:[0-9A-Fa-f]{{1,4}}:){{0,5}})(?:{_OCTET}\.){{3}}{_OCTET}"
    r"|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,7}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?"
    r"|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\p{L}\p{N}_]|:[0-9A-Fa-f:]|\.[0-9])",
    0.6,
    literals=(":",),
    hint=r":[0-9A-Fa-f]{0,4}:",
    name="IPV6",
)
URL_SCHEME = Rule(
    "URL", W_START + r"(?i:https?://|ftp://|www\.)[^\s<>\"'`{}|\\^\[\]]*[^\s<>\"'`{}|\\^\[\].,;:!?)]",
    0.6, hint=r"(?i)://|www\.", name="URL_SCHEME",
)


def url_bare(endings: Iterable[str] = TOP_DOMAINS) -> Rule:
    """Host names with one of the endings, in any case, and the path behind them."""
    ending = f"(?i:{'|'.join(endings)})"
    path = r"(?:/[^\s<>\"'`]*[^\s<>\"'`.,;:!?)])?(?![\p{L}\p{N}_\-])"
    return Rule(
        "URL", W_START + r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.){1,8}" + ending + path, 0.5,
        literals=(".",), hint=r"\." + ending, name="URL_BARE",
    )


URL_BARE = url_bare()
PHONE = Rule(
    "PHONE_NUMBER",
    r"(?<![\p{L}\p{N}_+])\+[1-9][0-9]{0,2}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9](?:[ .\-]?[0-9]){5,12}" + W_END,
    0.4,
    context=("phone", "number", "telephone", "cell", "cellphone", "mobile", "call"),
    literals=("+",),
    hint=r"\+[1-9]",
)


def java_form(rule: Rule) -> Rule:
    """A rule written in the Python dialect, for Java."""
    hint = rule.hint.replace(r"[\s\-]", rf"[{_SPACE}\-]") if rule.hint else None
    return replace(rule, pattern=unicode_form(rule.pattern), hint=hint)


PATTERN_RULES = Registry(
    [EMAIL, IBAN, CARD, IPV4, IPV6, URL_SCHEME, URL_BARE, PHONE] + [java_form(r) for r in (BSN, KVK, *NL_PHONE)]
)


def pattern_rules(entities: Iterable[str] | None = None) -> list[Rule]:
    """Rules of the wanted entities; an empty or unknown request means all."""
    wanted = [e for e in (entities or ()) if e in ENTITIES] or None
    return PATTERN_RULES.for_entities(wanted)


def detect_patterns(text: Column, entities: Iterable[str] | None = None, threshold: Column | float = 0.5) -> Column:
    """The rule part of the pattern layer of one text."""
    return detect(text, pattern_rules(entities), PATTERN, threshold)
