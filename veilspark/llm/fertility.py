"""Quality rules on tokeniser fertility, beside counts of words, symbols and repeats.

A public vocabulary encodes each word of a text (a leading word mark, byte fallback
for what it lacks). Three measures are taken over the whole text: characters per
token, the share of tokens that are fallback bytes, and the entropy of the tokens in
bits. Each script has a band for them; a text outside its script's band is rejected.
Entropy for the band is a mean over windows of at most `WINDOW` tokens that cover the
whole text, each held against its largest value for that many tokens: the entropy of a
whole text levels off as it grows while that value does not, so one band serves short and
long texts only with windows.

Fallback bytes count as noise unless they spell letters or marks of a script that the text
is written in, so symbols, private-use and unassigned code points do not pass as a script
that the vocabulary lacks. Scripts that a second, byte-level vocabulary knows better have a
least number of characters per token of that one too; the rest have no such measure.

Texts of a language lie much closer together than those of a script, so each language of
the column `lang` also has a norm per length (power of two of the tokens): median and spread of
characters per token and of relative entropy, exact over all different texts of the language that
pass the base rule, without labels (`norms_of_rated`). Texts are encoded once: `rate_by_norms` stores
their measures and takes the norms from these. The two distances from the medians, in
spreads, count together; a text too far on the low side is rejected. Languages with too few
texts, and texts without a language, have the bands of their script alone.

A null or empty text has no words and fails the base rule. Repeated rows and ties
change nothing; further columns of the input are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm import bpe
from veilspark.llm.shared import Known, map_arrow, slices, stored
from veilspark.llm.wordhash import BatchWords, repeated_trigram_words

#: Words kept per Python worker and half of the cache.
CACHE = 200_000
#: Words to a call of the vocabulary, and its mark of a word's start.
TOGETHER = 500
MARK = "\u2581"
#: Most noise bytes per token, and the least share of a text's letters that a script must have to be one of its own.
MOST_NOISE, OWN_SCRIPT = 0.25, 0.25
#: Most tokens of a window that entropy is taken over.
WINDOW = 1024
SYMBOLS = b"#*$%&|<>"
#: Fewest different texts of a language that give a norm for a length, and bins to a unit in which their measures are ranked.
LEAST_SAMPLE, BINS = 20, 1024
#: A text this many spreads below its language's norm is rejected. A spread is the distance that 80 % of the texts keep,
#: as a share of a normal distribution's, so that a group of near copies narrows it little; at least this share of the median.
MOST_BELOW, SPREAD_SHARE, SPREAD_NORMAL, LEAST_SPREAD = 3.0, 0.8, 1.2816, 0.005


@dataclass(frozen=True)
class Band:
    """Limits of a script: least and most characters per token, most share of byte tokens, least relative entropy,
    least characters per token of the second vocabulary."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    least_second: float = 0.0


#: Bands by script; "other" serves those without an own one. Cased alphabets of Europe give 2 to 5 characters a
#: token in running text; scripts that the vocabulary lacks fall back to bytes. Limits of the second vocabulary lie
#: between a sentence of running text and letters drawn at random.
BANDS = {
    "latin": Band(1.5, 8.0, 0.25, 0.4),
    "cyrillic": Band(1.2, 8.0, 0.3, 0.4),
    "greek": Band(0.4, 6.0, 0.9, 0.35, 0.9),
    "han": Band(0.3, 3.0, 0.9, 0.35, 0.55),
    "hangul": Band(0.2, 8.0, 1.0, 0.3, 0.6),
    "arabic": Band(0.2, 8.0, 1.0, 0.3, 1.05),
    "hebrew": Band(0.2, 8.0, 1.0, 0.3, 1.1),
    "thai": Band(0.2, 8.0, 1.0, 0.3, 0.8),
    "other": Band(0.2, 8.0, 1.0, 0.3),
    "none": Band(0.4, 8.0, 0.25, 0.4),
}
#: First words of code points' names that stand for several scripts, and names of scripts by them.
SEVERAL = {"LINEAR", "OLD", "TAI"}
NAMED = {"CJK": "han", "HIRAGANA": "han", "KATAKANA": "han", "FULLWIDTH": "latin", "HALFWIDTH": "han"}


@lru_cache(maxsize=1)
def scripts() -> tuple[list[str], np.ndarray]:
    """Names of scripts, and for each code point the number of the script that it is a letter or mark of (0: of none)."""
    names, of = {"": 0}, np.zeros(0x110000, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x33480)]))
    for ch in regex.findall(r"(?V1)[[\p{L}\p{M}]--[\p{Script=Common}\p{Script=Inherited}]]", points):
        words = unicodedata.name(ch, "").split("-")[0].split()
        if words:
            name = NAMED.get(words[0]) or " ".join(words[: 1 + (words[0] in SEVERAL)]).lower()
            of[ord(ch)] = names.setdefault(name, len(names))
    return list(names), of


class Vocabulary:
    """Pieces of words by a public sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.is_start = np.array([self.model.id_to_piece(i).startswith(MARK) for i in range(len(self.is_byte))])
        # every character that the model does not spell in bytes is a piece of its own
        self.lacks = np.ones(0x110000, bool)
        self.lacks[[ord(p) for i in range(len(self.is_byte)) if len(p := self.model.id_to_piece(i)) == 1]] = False
        self.known = Known(self._words, CACHE)

    def _words(self, words: list[bytes]) -> list[bytes]:
        """New words are encoded many to a call; each begins at a piece with the word mark."""
        texts = [word.decode(errors="replace") for word in words]
        odd = {i for i, text in enumerate(texts) if not text.isprintable() or MARK in text}
        plain = [text for i, text in enumerate(texts) if i not in odd] if odd else texts
        out = []
        for first in range(0, len(plain), TOGETHER):
            ids = np.array(self.model.encode(" ".join(plain[first : first + TOGETHER])), np.uint16)
            start = np.flatnonzero(self.is_start[ids]).tolist()
            raw = ids.tobytes()
            out += [raw[2 * a : 2 * b] for a, b in zip(start, [*start[1:], len(ids)])]
        for i in sorted(odd):
            out.insert(i, np.array(self.model.encode(texts[i]), np.uint16).tobytes())
        return out

    def pieces(self, rows: list[list[bytes]]) -> list[np.ndarray]:
        known = self.known.of({word for row in rows for word in row})
        return [np.frombuffer(b"".join(map(known.__getitem__, row)), np.uint16) for row in rows]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode(errors="replace").encode("utf-32-le"), np.uint32)


def script_of(text: bytes) -> str:
    """The script of most letters of a text; "other" for letters of no listed script, "none" without letters."""
    ascii_letters = sum(text.count(bytes([b])) for b in b"aeiounrst")
    if text.isascii() and ascii_letters:
        return "latin"
    names, of = scripts()
    counts = np.bincount(of[code_points(text)], minlength=len(names))
    listed = {name: int(n) for name, n in zip(names[1:], counts[1:]) if name in BANDS}
    best = max(listed, key=listed.get)
    rest = int(counts[1:].sum()) - sum(listed.values())
    if listed[best] >= max(1, rest):
        return best
    return "other" if rest else "none"


def noise_bytes(text: bytes, lacks: np.ndarray) -> int:
    """UTF-8 bytes of the characters that fall back to bytes and are no letters or marks of the text's own scripts."""
    names, of = scripts()
    points = code_points(text)
    script = of[points]
    counts = np.bincount(script, minlength=len(names))
    own = counts >= max(1, OWN_SCRIPT * counts[1:].sum())
    own[0] = False
    odd = points[lacks[points] & ~own[script]]
    return len(odd) + int((odd >= 0x80).sum() + (odd >= 0x800).sum() + (odd >= 0x10000).sum())


def chars_per_token(text: str, codec: bpe.Codec) -> float:
    """By the second vocabulary, with or without marks on letters, whichever it knows better."""
    bare = "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn")
    best = 0.0
    for form in {text, unicodedata.normalize("NFC", bare)}:
        best = max(best, sum(map(len, form.split())) / max(1, len(codec.encode([form])[0])))
    return best


def entropy_in_windows(ids: np.ndarray, window: int = WINDOW) -> tuple[float, float]:
    """Mean entropy (bits, and relative to its largest value) of the fewest windows of about equal size, at most `window`."""
    n, k = len(ids), -(-len(ids) // window)
    part = np.arange(n, dtype=np.int64) * k // n
    order = np.sort(part << 16 | ids)
    ends = np.flatnonzero(np.concatenate((order[1:] != order[:-1], [True])))
    count, size = np.diff(ends, prepend=-1), np.bincount(part)
    owner = order[ends] >> 16
    share = count / size[owner]
    bits = np.bincount(owner, weights=-share * np.log2(share), minlength=k)
    relative = np.where(size > 1, bits / np.log2(np.maximum(size, 2)), 1.0)
    return float(np.average(bits, weights=size)) + 0.0, float(np.average(relative, weights=size)) + 0.0


def measures(ids: np.ndarray, n_chars: int, is_byte: np.ndarray) -> tuple[float, float, float, float]:
    """Characters per token, share of byte tokens, entropy of the whole text in bits, and relative entropy in windows."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    entropy, relative = entropy_in_windows(ids, n)
    if n > WINDOW:
        relative = entropy_in_windows(ids)[1]
    return n_chars / n, float(is_byte[ids].mean()), entropy, relative


def in_band(chars: float, byte_share: float, relative: float, band: Band) -> bool:
    return band.least_chars <= chars <= band.most_chars and byte_share <= band.most_bytes and relative >= band.least_entropy


#: (median, spread) of characters per token and of relative entropy.
Norm = tuple[float, float, float, float]
Norms = dict[tuple[str, int], Norm]


def length_class(n_tokens: float) -> int:
    return int(np.log2(max(1.0, n_tokens)) + 1e-9)


def below(chars: float, relative: float, norm: Norm) -> float:
    """How many spreads a text lies below the norm, by both measures together."""
    return ((norm[0] - chars) / norm[1] + (norm[2] - relative) / norm[3]) / 2**0.5


def norm_of(norms: Norms, lang: str | None, n_tokens: float) -> Norm | None:
    """The norm of the nearest length that the language has one for, the shorter of two."""
    at = length_class(n_tokens)
    if (norm := norms.get((lang, at))) is None:
        near = min((k for own, k in norms if own == lang), key=lambda k: (abs(k - at), k), default=None)
        norm = norms.get((lang, near))
    return norm


def learn_norms(docs: DataFrame, path: str, sample: int | None = None) -> Norms:
    """Norms by language and length of all different texts of each language; no labels are read.

    sample: take so many texts of each language only, those with the least hashes.
    """
    if "lang" not in docs.columns:
        return {}
    keyed = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("text_key"))
    keyed = keyed.dropDuplicates(["lang", "text_key"])
    if sample is not None:
        order = F.row_number().over(Window.partitionBy("lang").orderBy("text_key"))
        least = keyed.select("lang", "text_key").withColumn("r", order).filter(F.col("r") <= sample).drop("r")
        keyed = keyed.join(least, ["lang", "text_key"])
    return norms_of_rated(rate(keyed.withColumn("doc_id", F.lit(0)), path, keep=("lang", "text_key")))


def quantile(values: DataFrame, share: float) -> DataFrame:
    """(lang, kind, measure, n, value): exact quantiles of the column v, between two neighbours in proportion.

    Equal values are counted first; ranks are those in a bin and those of the bins before it, so no task holds a group.
    """
    keys = ["lang", "kind", "measure"]
    counts = values.groupBy(*keys, F.floor(F.col("v") * BINS).alias("bin"), "v").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*keys)
    bins = counts.groupBy(*keys, "bin").agg(F.sum("c").alias("size"))
    bins = bins.select(*keys, "bin", (F.sum("size").over(whole.orderBy("bin")) - F.col("size")).alias("before"), F.sum("size").over(whole).alias("n"))
    rows = counts.withColumn("own", F.sum("c").over(Window.partitionBy(*keys, "bin").orderBy("v"))).join(bins, [*keys, "bin"])
    upto, at = F.col("before") + F.col("own"), (F.col("n") - 1) * F.lit(share)
    value_at = lambda k: F.max(F.when((k >= upto - F.col("c")) & (k < upto), F.col("v")))
    found = rows.groupBy(*keys, "n").agg(value_at(F.floor(at)).alias("low"), value_at(F.ceil(at)).alias("high"))
    part = at - F.floor(at)
    between = F.when(part < 0.5, F.col("low") + (F.col("high") - F.col("low")) * part).otherwise(F.col("high") - (F.col("high") - F.col("low")) * (1 - part))
    return found.select(*keys, "n", ((F.col("low") + F.col("high")) / 2 if share == 0.5 else between).alias("value"))


def norms_of_rated(rated: DataFrame) -> Norms:
    """Norms of rows of rate() with lang and text_key (the same for equal texts). The driver holds the norms, some ten per language."""
    kind = F.floor(F.log2(F.col("word_chars") / F.col("chars_per_token")) + 1e-9).cast("int")
    passed = rated.filter("lang is not null and text_key is not null and not base_failed and chars_per_token > 0")
    each = passed.groupBy("lang", "text_key").agg(
        F.min(kind).alias("kind"), F.array(F.min("chars_per_token"), F.min("relative_entropy")).alias("both")
    )
    keys = ["lang", "kind", "measure"]
    values = stored(each.select("lang", "kind", F.posexplode("both").alias("measure", "v")), "fertility-values")
    middles = stored(quantile(values, 0.5).filter(F.col("n") >= LEAST_SAMPLE).withColumnRenamed("value", "middle").drop("n"), "fertility-middles")
    far = quantile(values.join(middles, keys).withColumn("v", F.abs(F.col("v") - F.col("middle"))), SPREAD_SHARE)
    found = {}
    for r in middles.join(far, keys).collect():
        found.setdefault((r.lang, r.kind), {})[r.measure] = r.middle, max(r.value / SPREAD_NORMAL, LEAST_SPREAD * r.middle)
    return {key: (*of[0], *of[1]) for key, of in found.items()}


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, chars_per_token double, byte_share double, token_entropy double, relative_entropy double, below_norm double"
)


def rate(
    docs: DataFrame, path: str, bands: dict[str, Band] | None = None, second: tuple[str, str] | None = None, norms: Norms | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, script and the measures of fertility.

    base_failed: under 50 words, or more than half of the words stand in 3-word windows that the text holds twice.
    kept: the base rule holds, the measures lie in the band of the text's script, and few tokens are noise bytes.
    second: rank file and splitting pattern of the second vocabulary; without it, its limits do not hold.
    norms: of learn_norms(); without them, or a column lang, below_norm is null and rejects nothing.
    keep: columns of docs that pass through, after the others.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    bands = bands or BANDS
    norms = norms or {}
    with_lang = bool(norms) and "lang" in docs.columns
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def one(text: bytes, lang: str | None, words: list[bytes], hashes: np.ndarray, ids: np.ndarray, vocab: Vocabulary) -> tuple:
        joined = b"".join(words)
        chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
        lines = [line for line in text.split(b"\n") if line.split(None, 1)]
        repeats = repeated_trigram_words(hashes)
        failed = len(words) < 50 or 100 * repeats > 50 * len(words)
        script = script_of(joined)
        per_token, byte_share, entropy, relative = measures(ids, chars, vocab.is_byte)
        band = bands.get(script, bands["other"])
        norm = norm_of(norms, lang, len(ids)) if len(ids) else None
        under = below(per_token, relative, norm) if norm else None
        kept = not failed and in_band(per_token, byte_share, relative, band) and (under is None or under <= MOST_BELOW)
        # noise is part of the byte tokens
        if kept and byte_share > MOST_NOISE:
            kept = noise_bytes(joined, vocab.lacks) <= MOST_NOISE * len(ids)
        if kept and second and band.least_second:
            kept = chars_per_token(text.decode(errors="replace"), bpe.codec(*second)) >= band.least_second
        symbols = sum(text.count(bytes([s])) for s in SYMBOLS)
        return len(words), chars, symbols, len(lines) - len(set(lines)), repeats, failed, kept, script, per_token, byte_share, entropy, relative, under

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocab = vocabulary(path)
        out = []
        raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text").cast(pa.binary())]
        langs = batch.column("lang").cast(pa.string()).to_pylist() if with_lang else [None] * len(raw)
        for part in slices(raw):
            words = [text.split() for text in part]
            hashes = BatchWords(part)
            for i, ids in enumerate(vocab.pieces(words)):
                out.append(one(part[i], langs[len(out)], words[i], hashes.of(i), ids, vocab))
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
        columns = [pa.array(c, kinds[d.split()[1]]) for c, d in zip(zip(*out), COLUMNS.split(", "))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *[batch.column(c) for c in keep]], ["doc_id", *names, *keep])

    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select("doc_id", "text", *[c for c in docs.columns if c in keep or with_lang and c == "lang"]), rows, f"doc_id {kind}, {COLUMNS}{kept}")


def rate_by_norms(docs: DataFrame, path: str, bands: dict[str, Band] | None = None, second: tuple[str, str] | None = None) -> DataFrame:
    """rate() with the norms of all different texts of docs, for one pass over the texts."""
    if "lang" not in docs.columns:
        return rate(docs, path, bands, second)
    key = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    keyed = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), key.alias("text_key"))
    rated = stored(rate(keyed, path, bands, second, keep=("lang", "text_key")), "fertility")
    norms = norms_of_rated(rated)
    names = [c for c in rated.columns if c not in ("lang", "text_key")]

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        under = []
        for lang, chars, per_token, relative in zip(*(batch.column(c).to_pylist() for c in ("lang", "word_chars", "chars_per_token", "relative_entropy"))):
            norm = norm_of(norms, lang, round(chars / per_token)) if per_token else None
            under.append(below(per_token, relative, norm) if norm else None)
        kept = [k and (u is None or u <= MOST_BELOW) for k, u in zip(batch.column("kept").to_pylist(), under)]
        made = {"kept": pa.array(kept, pa.bool_()), "below_norm": pa.array(under, pa.float64())}
        return pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names)

    return map_arrow(rated, held, rated.select(names).schema)
