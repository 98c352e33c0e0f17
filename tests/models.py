"""Brute-force models of the row-local logic, over plain Python values."""

import re

RANK = {"secret": 3, "pattern": 2, "lexicon": 1, "crossref": 1}


def merge(findings):
    """Replay the merge over (start, end, score, source, label) tuples."""
    kept = []
    for f in sorted(findings, key=lambda f: (f[0], -f[2], -RANK.get(f[3], 0))):
        if kept and f[0] < kept[-1][1]:
            top = kept[-1]
            stronger = (f[2], RANK.get(f[3], 0)) > (top[2], RANK.get(top[3], 0))
            if stronger and f[1] > top[1]:
                kept[-1] = f
        else:
            kept.append(f)
    return kept


def cover(findings):
    """Extents of the clusters, by painting characters and seams."""
    spans = []
    for f in sorted(findings):
        if spans and f[0] < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], f[1])
        else:
            spans.append([f[0], f[1]])
    return [tuple(s) for s in spans]


def redact(text, merged):
    out, at = [], 0
    for start, end, _, source, label in merged:
        shown = {"secret": f"REDACTED:{label}", "pattern": label}.get(source, label.upper())
        out += [text[at:start], f"[{shown}]"]
        at = end
    return "".join(out) + text[at:]


def names_of(address, skip):
    local = address.partition("@")[0] if "@" in address else ""
    if len(local) < 3:
        return []
    return [p for p in re.split("[._-]", local) if len(p) > 1 and p.isalpha() and p.lower() not in skip]


def propagate(text, findings, skip):
    """Claims of (label, start, end, score, value, reason), on a painted canvas.

    `findings` are (start, end, score, label, value).
    """
    painted = bytearray(len(text))
    for start, end, *_ in findings:
        painted[start:end] = b"\x01" * (end - start)
    queue = [(v, label, 0.7 if score is None else score, "value-propagation") for _, _, score, label, v in findings
             if len(v) >= 3 and v.lower() not in skip]
    for _, _, _, label, v in findings:
        if label in ("EMAIL_ADDRESS", "email"):
            queue += [(n, "PERSON", 0.5, "email-extraction") for n in names_of(v, skip) if len(n) >= 3]
    claims = []
    for value, label, score, reason in queue:
        for m in re.finditer(rf"\b{re.escape(value)}\b", text, re.I):
            if not any(painted[m.start():m.end()]):
                painted[m.start():m.end()] = b"\x01" * len(m.group())
                claims.append((label, m.start(), m.end(), score, m.group(), reason))
    return claims
