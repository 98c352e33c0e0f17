"""Text scalars: lengths, slices, decoding, log masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.rowsql import let, struct

# Word characters as Python's `\w` sees them; written as classes so that the
# meaning does not depend on the Java release.
WORD = r"\p{L}\p{N}_"
W_START = rf"(?<![{WORD}])"
W_END = rf"(?![{WORD}])"
W_BOUND = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
# ASCII word boundaries, for rules that come from a non-Unicode dialect.
A_START = r"(?<![A-Za-z0-9_])"
A_END = r"(?![A-Za-z0-9_])"

RUNS = rf"[{WORD}]+|[^{WORD}]+"

_SEG_BITS = 10
_SEG = 1 << _SEG_BITS


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units (characters above U+FFFF count twice)."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("bigint")


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8; malformed sequences become U+FFFD, a byte order mark stays."""
    return F.make_valid_utf8(content.cast("string"))


def segments(text: str) -> str:
    """SQL: cut a text into fixed runs of code points.

    `substring` walks from the start of the string, so many slices of a long text
    cost (slices x length). Slicing out of segments costs (slices x segment).
    """
    return f"regexp_extract_all({text}, '(?s).{{1,{_SEG}}}', 0)"


def segment_slice(segs: str, start: str, end: str) -> str:
    """SQL: code points [start, end) of the text behind `segs`."""

    def cut(p: str) -> str:
        a, b = f"{p}.a", f"{p}.b"
        first, last = f"shiftright({a}, {_SEG_BITS})", f"shiftright({b} - 1, {_SEG_BITS})"
        head, tail = f"({a} & {_SEG - 1}) + 1", f"(({b} - 1) & {_SEG - 1}) + 1"
        return (
            f"CASE WHEN {b} <= {a} THEN '' "
            f"WHEN {first} = {last} THEN substring(get({segs}, {first}), {head}, {b} - {a}) "
            f"ELSE concat(substring(get({segs}, {first}), {head}), "
            f"array_join(slice({segs}, {first} + 2, {last} - {first} - 1), ''), "
            f"substring(get({segs}, {last}), 1, {tail})) END"
        )

    return let(struct(a=start, b=end), cut)


def fold_case(text: str) -> str:
    """SQL: equal for any two texts that match each other without case."""
    return f"upper(lower(translate({text}, 'İ', 'i')))"


# Patterns masked in log lines, applied in this order.
LOG_PATTERNS = (
    r"\b[0-9]{9}\b",
    r"\bNL\d{2}[A-Z]{4}\d{10}\b",
    r"\b06[- ]?\d{8}\b",
    r"\+31[- ]?\d{9}\b",
    r"\b\d{4}\s?[A-Z]{2}\b",
)
LOG_MASK = "[FILTERED]"

# The log dialect's `\s` takes these besides ASCII white space.
_LOG_SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def _log_regex(pattern: str) -> str:
    """The same pattern for Java: ASCII word boundaries, wider white space."""
    if pattern.startswith(r"\b"):
        pattern = A_START + pattern.removeprefix(r"\b")
    if pattern.endswith(r"\b"):
        pattern = pattern.removesuffix(r"\b") + A_END
    return pattern.replace(r"\s", _LOG_SPACE)


def mask_log(line: Column) -> Column:
    """Mask identifiers in a log line. Order matters: a later pattern sees the
    output of an earlier one."""
    out = line
    for pattern in LOG_PATTERNS:
        out = F.regexp_replace(out, _log_regex(pattern), LOG_MASK)
    return out
