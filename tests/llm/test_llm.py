"""The training-data operators against brute force, round trips and held-out rows, and on odd inputs."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veilspark.llm import bpe, components, fertility, language, line_dedup, mixing, ngram_join, token_counts, tokens_orc, toxicity, vectors
from veilspark.llm.shared import Known, new_folder
from veilspark.llm.wordhash import BatchWords, repeated_trigram_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, entry string, node long"


def odd_rows(n_words=400):
    """Nulls in every column, empty and very long texts, repeated rows, further columns with clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300)]
    long = " ".join(rng.choices(words, k=30_000))
    texts = [None, "", "   \n\t ", "one", "two words", long, *[" ".join(rng.choices(words, k=n_words)) for _ in range(6)]]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, "x", 1) for i, t in enumerate(texts)]
    rows += [(None, texts[6], None, None, None, None, None), rows[7], rows[7], (99, texts[8], "de", "t", 3, "y", 2)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- byte-level BPE

def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 40), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_segment_trees_merge_as_plain_search_does():
    codec, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choices("aeiostrnéß日 ", k=rng.randint(2, 40))).encode()
        want = plain_merge(piece, codec.ranks)
        if piece not in codec.ranks:
            size = max(4, 1 << (len(piece) - 1).bit_length())
            assert bpe.merge_piece(piece, codec.ranks) == want
            if size <= bpe.WIDEST:
                assert bpe.merge_pieces([piece], codec.pairs, size)[0].tolist() == want


def test_bpe_equals_the_public_library_and_round_trips():
    import tiktoken

    codec, rng = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(2)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    some = ["".join(rng.choices("ab  \n\t'sd123é日本　 \x1c\x85_-!?🙂'llI'm", k=rng.randint(0, 60))) for _ in range(800)]
    some += ["", " " * 300, "a" * 5000]
    encoded = codec.encode(some)
    assert encoded == [library.encode_ordinary(t) for t in some]
    assert [codec.decode(ids).decode() for ids in encoded] == some


def test_bpe_digests_on_odd_rows(spark, odd, empty):
    got = bpe.encode_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == odd.count()
    texts = collections.Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd.collect())
    assert collections.Counter(r.decoded_sha256 for r in got) == texts
    encoded = bpe.encode_texts(odd, RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: r.text for r in bpe.decode_ids(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back[0] == "" and back[4] == "two words"
    assert bpe.encode_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_known_forgets_but_stays_right():
    known = Known(lambda keys: [k * 2 for k in keys], 3)
    for k in (1, 2, 3, 4, 5, 1, 2, 9):
        assert known.of({k, k + 1}) == {k: 2 * k, k + 1: 2 * k + 2}
    assert len(known.young) + len(known.old) <= 8


# --- token ids in ORC

def test_orc_token_files_read_back_in_order(spark, odd, empty):
    from tokenizers import Tokenizer

    path, tokenizer = new_folder(spark, "orc"), public_tokenizers.path("word_bpe_49k.json")
    tokens_orc.write_tokens(odd, tokenizer, path)
    library = Tokenizer.from_file(tokenizer)
    want = sorted(((r.doc_id is not None, r.doc_id or 0), len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
    got = sorted(tokens_orc.token_report(spark, path).collect(), key=lambda r: r.start)
    assert [((r.doc_id is not None, r.doc_id or 0), r.n_tokens) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *[n for _, n in want]])[:-1].tolist()
    assert tokens_orc.read_tokens(spark, path, [4]).select("ids").first().ids[-1] == tokens_orc.END
    none = new_folder(spark, "orc")
    tokens_orc.write_tokens(empty, tokenizer, none)
    assert tokens_orc.token_report(spark, none).count() == 0


def test_orc_report_equals_the_whole_tokenizer_and_reads_by_metadata(spark):
    import zlib

    from tokenizers import Tokenizer
    from veilspark.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    tokenizer, want, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for r in docs:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op6_token_orc(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want

    import pyarrow.orc as orc

    path = new_folder(spark, "orc-metadata")
    tokens_orc.write_tokens(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), public_tokenizers.path("word_bpe_49k.json"), path, stride=1000)
    files = [f.removeprefix("file:") for f in spark.read.orc(path).inputFiles()]
    raw = b"".join(open(f, "rb").read() for f in files)
    assert all(orc.ORCFile(f).nstripes for f in files) and len(raw)
    plan = tokens_orc.read_tokens(spark, path, [7])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan or "PushedFilters: [In(doc_id" in plan
    assert [r.doc_id for r in tokens_orc.read_tokens(spark, path, [7, 4999, 5000]).collect()] in ([7, 4999], [4999, 7])


def test_word_cache_gives_what_whole_texts_give():
    encoder, rng = tokens_orc.Encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    some = ["".join(rng.choices("aB  \n'sd12é日　\x1c\x01_-!?.,ΣσI'm", k=rng.randint(0, 50))) for _ in range(500)] + ["a<|endoftext|>b c."]
    some += ["".join(rng.choices("ab Zé'sßİKÅΣς.,!?;<|>0123９ñÑ\u0301ﬁ日\x1c\x85\t_-ll're €µªº²¼\xa0", k=rng.randint(0, 60))) for _ in range(3000)]
    some += ["<|endoftext|> a<|startoftext|>b", "Kelvin ẞẞ İstanbul ΣΑΣ"]
    for text, raw in zip(some, encoder.encode(some, 2)):
        assert np.frombuffer(raw, "<u4").tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]


# --- quality rules

def test_repeat_counts_and_pieces():
    rng = random.Random(4)
    some = [" ".join(rng.choices("abc", k=rng.randint(0, 30))).encode() for _ in range(300)]
    hashes = BatchWords(some)
    for i, text in enumerate(some):
        words = text.split()
        seen = collections.Counter(zip(words, words[1:], words[2:]))
        want = {j + k for j in range(len(words) - 2) if seen[tuple(words[j : j + 3])] > 1 for k in range(3)}
        assert repeated_trigram_words(hashes.of(i)) == len(want)
    vocab = fertility.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    words = [w.encode() for w in ("▁a", "ab", "\x00q", "日本", "the", "a b", "é")]
    assert vocab._words(words) == [np.array(vocab.model.encode(w.decode()), np.uint16).tobytes() for w in words]


def test_fertility_rejects_out_of_band_texts(spark, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(6)
    clean = " ".join("".join(rng.choices(["the", "in", "er", "ation", "ly"], k=2)) for _ in range(80))
    noise = " ".join("".join(chr(rng.randint(0x10000, 0x10400)) for _ in range(5)) for _ in range(80))
    rows = [(1, clean), (2, " ".join(chr(0xE000 + rng.randrange(6000)) + "a" for _ in range(80))), (3, "x " * 200), (4, noise)]
    got = {r.doc_id: r for r in fertility.rate(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got[1].kept and not got[1].base_failed
    assert not got[2].kept and not got[2].base_failed and got[2].byte_share > 0.25
    assert got[3].base_failed and not got[3].kept
    assert fertility.rate(odd, path).count() == odd.count() and fertility.rate(empty, path).count() == 0


def test_entropy_does_not_fall_with_length():
    rng = np.random.default_rng(14)
    share = 1 / np.arange(1, 301)
    is_byte = np.zeros(32_000, bool)
    clean = rng.choice(300, size=1_000_000, p=share / share.sum()).astype(np.uint16)
    poor = rng.choice(3, size=1_000_000).astype(np.uint16)
    band = fertility.BANDS["latin"]
    for n in (150, 1_000, 1_500, 20_000, 1_000_000):
        for ids, kept in ((clean[:n], True), (poor[:n], False)):
            per_token, byte_share, entropy, relative = fertility.measures(ids, 3 * n, is_byte)
            assert fertility.in_band(per_token, byte_share, relative, band) == kept
            share_of = np.bincount(ids)[np.bincount(ids) > 0] / n
            assert abs(entropy + (share_of * np.log2(share_of)).sum()) < 1e-9
    values = [fertility.measures(clean[:n], n, is_byte)[3] for n in (1_024 * 20, 1_000_000)]
    assert abs(values[0] - values[1]) < 0.01
    # windows cover the text to its end
    half = np.concatenate((clean[:5_000], np.zeros(5_000, np.uint16)))
    assert fertility.measures(half, 1, is_byte)[3] < 0.6 * fertility.measures(clean[:10_000], 1, is_byte)[3]
    assert fertility.measures(clean[:1], 1, is_byte)[2:] == (0.0, 1.0) and fertility.measures(clean[:0], 0, is_byte)[3] == 0.0


def test_fertility_rejects_byte_noise_and_keeps_scripts_spelled_in_bytes(spark):
    rng = random.Random(15)
    words = lambda chars, n=80: " ".join("".join(chr(rng.choice(chars)) for _ in range(5)) for _ in range(n))
    running = {
        "greek": "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει στο δάσος κάθε πρωί",
        "arabic": "يقفز الثعلب البني السريع فوق الكلب الكسول ويركض إلى الغابة كل صباح",
        "hebrew": "השועל החום המהיר קופץ מעל הכלב העצלן ורץ אל היער בכל בוקר",
        "hangul": "빠른 갈색 여우가 게으른 개를 뛰어넘어 매일 아침 숲으로 달려갑니다",
        "other": "ፈጣኑ ቡናማ ቀበሮ ሰነፉን ውሻ ዘሎ በየቀኑ ጠዋት ወደ ጫካ ይሮጣል",
        "han": "敏捷的 棕色 狐狸 每天 早上 跳过 懒狗 跑进 森林里 寻找 食物 然后 回家 休息",
    }
    good = [(i, name, " ".join(rng.choices(text.split(), k=80))) for i, (name, text) in enumerate(running.items())]
    bad = [
        words(range(0x10000, 0x10400)), words(range(0xE000, 0xF701)), words(range(0x1F300, 0x1F650)), words(range(0x1D400, 0x1D6A4)),
        words(range(0x590, 0x700)), words(range(0x391, 0x3A1)), words(range(0xAC00, 0xD7A4)), words(range(0x4E00, 0xA000)),
        " ".join(w + " " + n for w, n in zip(running["other"].split() * 8, words(range(0xE000, 0xF701)).split())),
        " ".join(["-" * (40 + i % 30) for i in range(80)]),
    ]
    docs = spark.createDataFrame([(i, t) for i, _, t in good] + [(100 + i, t) for i, t in enumerate(bad)], "doc_id long, text string")
    second = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    got = {r.doc_id: r for r in fertility.rate(docs, public_tokenizers.path("piece_bpe_32k.model"), second=second).collect()}
    assert {i: (got[i].script, got[i].kept) for i, _, _ in good} == {i: (name, True) for i, name, _ in good}
    assert {i: got[i].kept for i in got if i >= 100} == {100 + i: False for i in range(len(bad))}
    assert not any(got[i].base_failed for i in got if i < 109)
    # byte tokens are those of the characters that the vocabulary lacks
    vocab = fertility.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for _, _, text in good:
        lost = sum(len(c.encode()) for c in text.replace(" ", "") if vocab.lacks[ord(c)])
        assert vocab.is_byte[vocab.pieces([text.encode().split()])[0]].sum() == lost


# --- toxicity and language

def test_toxicity_is_learned_from_labels(spark, odd, empty):
    rng = random.Random(7)
    words = ["".join(rng.choices("aeionrstlm", k=rng.randint(2, 7))) for _ in range(200)]
    make = lambda bad: " ".join(rng.choices(words, k=60) + (["grobian"] if bad else []))
    rows = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.filter("doc_id < 300").select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[i].predicted == t for i, _, t in rows if i >= 300]) > 0.9
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, docs.select("doc_id", "toxic").limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_toxicity_scale_does_not_move_with_the_sample(spark):
    rng = random.Random(16)
    words = ["".join(rng.choices("aeionrstlm", k=rng.randint(2, 7))) for _ in range(60)]
    # the telling word stands in all toxic texts and a fifth of the others: about 1 toxic in 3 where it stands
    make = lambda bad: " ".join(rng.choices(words, k=30) + (["grobian"] if bad or rng.random() < 0.2 else []))
    rows = [(i, make(i % 10 == 0), int(i % 10 == 0)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    labels = docs.select("doc_id", "toxic")
    held = [text for _, text, _ in rows]
    odds = lambda model: np.log(model.scores(held) / (1 - model.scores(held)))
    whole = odds(toxicity.train(docs, labels))
    for most_toxic, most_other in ((300, 300), (100, 2700), (150, 300)):
        some = odds(toxicity.train(docs, labels, most_toxic, most_other))
        assert abs(np.median(some) - np.median(whole)) < 0.7 and abs(some.mean() - whole.mean()) < 0.7


def test_chains_equal_sums_over_all_paths():
    rng = np.random.default_rng(8)
    emission, move, begin = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.zeros(3)
    got = language.chains(emission, np.array([4, 0, 3]), move, begin)
    for at, n in ((0, 4), (4, 3)):
        total = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            weight = np.exp(sum(emission[at + i, k] for i, k in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            for i, k in enumerate(path):
                total[i, k] += weight
        assert np.allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True))


def test_languages_of_whole_and_switched_texts(spark, odd, empty):
    rng = random.Random(9)
    stems = {"xx": ["alo", "bera", "cino"], "yy": ["thrk", "wossh", "ngruf"]}
    make = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.filter("doc_id < 60"))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    _, share = model.label([make("xx", 10) + " " + make("yy", 10)])
    assert (share.argmax(axis=1) == [0] * 10 + [1] * 10).all()
    odd_got = language.identify(odd, model).collect()
    assert {r.lang_pred for r in odd_got if r.doc_id in (0, 1, 2)} == {"und"} and len(odd_got) == odd.count()
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(empty)).collect()} == {"und"}


# --- mixing

def test_mix_meets_targets(spark, odd, empty):
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.randint(0, 900)), rng.choice(["a", "b", None, "c"]), i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix_report(docs).collect()
    assert len(got) == 400 and all(r.taken <= 2 * r.size for r in got)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    source = {i: s for i, _, s, _ in rows}
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    left, free, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while over := [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]:
        for s in over:
            want[s] = 2 * sizes[s]
            free.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(want.values())
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) < 0.03 * want[s] for s in sizes)
    assert sorted(got) == sorted(mixing.mix_report(docs).collect())
    assert mixing.mix_report(odd).count() >= odd.count() and mixing.mix_report(empty).count() == 0
    out = mixing.mixed_documents(docs).collect()
    by = collections.Counter()
    for r in out:
        by[r.doc_id] += len(WORD.findall(r.text))
    assert all(by[r.doc_id] == r.taken for r in got)


def test_permutations_are_one_to_one(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    held = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(held) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(held), failed


def test_fertility_counts_and_norms_of_languages(spark):
    """Base counts against plain Python on whole given texts; norms, learned without labels, part the labelled qualities."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = public_tokenizers.path("piece_bpe_32k.model")
    norms = fertility.learn_norms(docs, path)
    rows = fertility.rate(docs, path, norms=norms).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert plain_counts(texts[r.doc_id]) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    quality = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {q: [r.kept for r in rows if not r.base_failed and quality.get(r.doc_id) == q] for q in (0, 1)}
    assert np.mean(kept[0]) < 0.5 and np.mean(kept[1]) > 0.98


def test_fertility_norms_are_bounded_and_optional(spark, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert fertility.learn_norms(empty, path) == {} and fertility.learn_norms(odd.drop("lang"), path) == {}
    assert fertility.rate(odd, path, norms={("en", 5): (2.0, 0.1, 0.7, 0.1)}).count() == odd.count()
    norms = {("en", 6): (2.0, 0.1, 0.7, 0.1), ("en", 8): (3.0, 0.1, 0.7, 0.1)}
    assert fertility.norm_of(norms, "en", 100)[0] == 2.0 and fertility.norm_of(norms, "en", 130)[0] == 2.0
    assert fertility.norm_of(norms, "en", 10**6)[0] == 3.0 and fertility.norm_of(norms, "xx", 100) is fertility.norm_of(norms, None, 100) is None
    # one text that half of the rows hold counts once, and the sample is bounded
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoin", k=rng.randrange(2, 8))) for _ in range(400)]
    rows = [("a", " ".join(rng.choices(words, k=60))) for _ in range(60)]
    twice = rows + rows[:1] * 60 + [(None, rows[0][1]), ("a", None), ("a", "")]
    one, many = (fertility.learn_norms(spark.createDataFrame(x, "lang string, text string"), path) for x in (rows, twice))
    assert one and one == many
    assert fertility.learn_norms(spark.createDataFrame(rows, "lang string, text string"), path, sample=fertility.LEAST_SAMPLE - 1) == {}


def test_fertility_norms_are_those_of_all_texts(spark, empty, odd):
    rng = np.random.default_rng(3)
    groups = {("a", 5): rng.normal(3, 0.2, 6_001), ("a", 6): np.repeat(rng.random(7), 5), ("b", 5): np.array([0.5, 0.25]), ("c", 1): np.array([2.0])}
    values = spark.createDataFrame([(*g, 0, float(v)) for g, vs in groups.items() for v in vs], "lang string, kind int, measure int, v double")
    for share in (0.5, 0.8):
        got = {(r.lang, r.kind): (r.n, r.value) for r in fertility.quantile(values, share).collect()}
        assert got == {g: (len(vs), pytest.approx(np.quantile(vs, share), abs=1e-14)) for g, vs in groups.items()}
    # more texts than any sample of 5,000 held; all of them count, each once
    rows = [(i, "x", i, 60, 60 / float(v), float(v)) for i, v in enumerate(rng.uniform(0.5, 1, 5_500))]
    rated = spark.createDataFrame(rows * 2, "doc_id long, lang string, text_key long, word_chars long, chars_per_token double, relative_entropy double")
    norm = fertility.norms_of_rated(rated.withColumn("base_failed", F.lit(False)))
    for kind in (4, 5):
        mine = np.array([r[5] for r in rows if int(np.log2(r[3] / r[4]) + 1e-9) == kind])
        assert (len(mine) >= 20) == (("x", kind) in norm)
        if len(mine) >= 20:
            assert norm["x", kind][2] == pytest.approx(np.median(mine), abs=1e-12)
    # one pass gives what norms and rows give apart
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = fertility.rate_by_norms(docs, path).collect()
    apart = fertility.rate(docs, path, norms=fertility.learn_norms(docs, path)).collect()
    assert sorted(one) == sorted(apart) and any(r.below_norm is not None for r in one)
    assert fertility.rate_by_norms(odd, path).count() == odd.count() and fertility.rate_by_norms(empty, path).count() == 0


# --- line dedup

def test_line_dedup_deletes_later_runs_only(spark, odd, empty):
    rng = random.Random(11)
    line = lambda n=12: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    run, own, single = [line() for _ in range(6)], [[line() for _ in range(4)] for _ in range(4)], line(60)
    docs = [
        (1, "\n".join([*own[0], *run, own[0][0][:20]])),
        (2, "\n".join([own[1][0], "", *run[:5], *own[1][1:]])),
        (3, "\n".join([*run[:2], *own[2]])),
        (4, "\n".join([*own[3], single, own[3][0], single])),
        (5, single),
    ]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text == docs[0][1] and got[3].text == docs[2][1]
    assert got[2].text == "\n".join([own[1][0], "", *own[1][1:]]) and got[2].n_deleted == 5
    assert got[4].text == "\n".join([*own[3], single, own[3][0]])
    assert got[5].text == "" and got[5].n_deleted == 1
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and out.filter("doc_id = 0").first().text is None
    assert line_dedup.dedup_lines(empty).count() == 0


def plain_repeats(docs, least):
    """Lines with words of each run of `least` words or more that equals a run at an earlier place, by comparing all pairs of places."""
    rows = {d: [(i, x, len(x.split())) for i, x in enumerate(text.split("\n")) if x.split()] for d, text in docs}
    places = [(d, a) for d in sorted(rows) for a in range(len(rows[d]))]
    gone = set()
    for i, (d, a) in enumerate(places):
        for o, b in places[:i]:
            k = words = 0
            while a + k < len(rows[d]) and b + k < len(rows[o]) and rows[d][a + k][1] == rows[o][b + k][1]:
                words += rows[d][a + k][2]
                k += 1
            if words >= least:
                gone |= {(d, rows[d][x][0]) for x in range(a, a + k)}
    return gone


@pytest.mark.parametrize("sizes", [(25,), (3, 8, 20), (1, 30, 60, 200)])
def test_line_dedup_finds_every_repeated_run(spark, sizes):
    rng = random.Random(sum(sizes))
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice(sizes)) + [f"x{i}"]) for i in range(40)]
    docs = []
    for d in range(90):
        lines = []
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(pool))
            lines += pool[at : at + rng.randrange(1, 9)] + [f"own {d} {rng.random()}"] * rng.randrange(2) + [""] * rng.randrange(2)
        docs.append((d, "\n".join(lines)))
    # a short first place of the fingerprint, and periods inside a document
    docs += [(90, "\n".join(pool[:2])), (91, "\n".join(pool[:3])), (92, "\n".join(pool[:3] * 3)), (93, "\n".join(pool[:1] * 70))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    keys = {r.doc: r.doc_id for r in rows.select("doc_id", F.xxhash64("doc_id", "text").alias("doc")).collect()}
    got = {(keys[r.doc], r.line) for r in line_dedup.repeated_lines(rows).collect()}
    need = plain_repeats(docs, line_dedup.RUN)
    assert need and need <= got
    # a gram runs over whole lines, so what goes beyond holds at least `GRAM` words and repeats too
    assert got <= plain_repeats(docs, line_dedup.GRAM)


def test_language_memory_follows_one_part_of_the_texts():
    """Features of a part are gone before the next one; what is held at a time does not grow with the texts of a batch."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(500)]
    model = language.fit_model([" ".join(words[:200]), " ".join(words[200:])], ["xx", "yy"], rounds=1)
    some = [" ".join(rng.choices(words, k=500)) for _ in range(1_000)]
    language.letters()
    tracemalloc.start()
    languages, _ = model.predict(some)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(languages) == 1_000 and peak < 40_000_000, peak


# --- n-gram Jaccard

def plain_components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(ngram_join, "FREQUENT", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(width)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    texts = []
    for size in (6, 12, 40, 150):
        for _ in range(4):
            base = rng.choices(words, k=size)
            for _ in range(12):
                copy = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
                texts.append(" ".join(copy))
    rows = list(enumerate([*texts, "", None, "One", "one", "a b", "A  b"]))
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = set(zip(*[w[k:] for k in range(width)])) if len(w) >= width else {tuple(w)} if w else set()
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Rule(width, percent)).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == plain_components(sets, percent)


def test_jaccard_families_grow_together_before_sets_meet_in_blocks(spark, monkeypatch):
    """A family of alike texts, each linked with some of the others, leaves few sets to be held against each other."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 24)
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2_000)]
    base, rows = rng.choices(words, k=300), []
    for i in range(100):
        own = list(base)
        for at in rng.sample(range(300), (1, 2, 4)[i % 3]):
            own[at] = rng.choice(words)
        rows.append((i, " ".join(own)))
    sets = {i: set(zip(*[t.split()[k:] for k in range(3)])) for i, t in rows}
    found, candidates = [], ngram_join.candidates

    def watched(index, info, labels, percent):
        met = index.join(labels, "node", "left").selectExpr("entry", "node", "coalesce(component, node) as component")
        by = met.groupBy("entry").agg(F.count_distinct("component").alias("k"), F.count("*").alias("c"))
        found.append(by.filter("k > 1").agg(F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0))).first()[0])
        return candidates(index, info, labels, percent)

    monkeypatch.setattr(ngram_join, "candidates", watched)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_components(sets, 90)
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) < 50
    assert found[0] < 500, found


def test_jaccard_families_that_do_not_link_meet_by_their_differences(spark, monkeypatch):
    """Texts that are alike but too far from each other to link make no rows with the square of their number; links among them stay."""
    for name, value in (("FREQUENT", 24), ("BLOCK", 8), ("WHOLE", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3_000)]
    base, texts = rng.choices(words, k=140), []
    for i in range(240):
        own = list(base)
        for at in rng.sample(range(140), (0, 1, 2, 3, 3, 3, 4, 4)[i % 8]):
            own[at] = rng.choice(words)
        texts.append(own)
        if i % 6 == 0:  # a near copy of this one alone, some words away from both ends of it
            texts.append([*own[:70], rng.choice(words), *own[71:]])
    rows = list(enumerate(map(" ".join, texts)))
    sets = {i: set(zip(*[t.split()[k:] for k in range(3)])) for i, t in rows}
    found, candidates = [], ngram_join.candidates

    def watched(index, info, labels, percent):
        rest = ngram_join.divided(index, labels).groupBy("entry").count()
        found.append(rest.agg(F.coalesce(F.sum(F.expr("count * ceil(count / 8)")), F.lit(0))).first()[0])
        return candidates(index, info, labels, percent)

    monkeypatch.setattr(ngram_join, "candidates", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for rounds in (0, 2):
        monkeypatch.setattr(ngram_join, "FINER", rounds)
        got[rounds] = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert got[2] == got[0] == plain_components(sets, 90)
    assert 2 * found[1] < found[0], found


def test_entries_fall_into_runs_of_sizes_that_no_link_spans(spark):
    rows = [(1, 10, 100), (1, 11, 111), (1, 12, 123), (1, 13, 140), (1, 14, 1000), (2, 10, 100), (2, 10, 100)]
    got = ngram_join.in_runs(spark.createDataFrame(rows, "entry long, node long, n int"), 90).collect()
    assert sorted(r.node for r in got) == [10, 11, 12] and len({r.entry for r in got}) == 1


def test_index_parts_cover_the_differences():
    for percent in (80, 90):
        rule = ngram_join.Rule(3, percent)
        for n in range(rule.least(), 600):
            for m in range(n, 100 * n // percent + 1):
                shared = dict(rule.parts(n)).keys() & dict(rule.parts(m)).keys()
                assert any(dict(rule.parts(m))[k] > (n + m) * (100 - percent) // (100 + percent) for k in shared)


def test_jaccard_on_odd_rows(spark, odd, empty):
    got = ngram_join.jaccard_components(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (8, 99)} == {8}
    assert {r.component_id for r in got if r.doc_id is None} == {6}
    assert ngram_join.jaccard_components(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 40 else 100 for i in [*range(41), *range(100, 130)]}


# --- vectors

def test_near_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 64))
    some = [base[i % 40] + rng.normal(size=64) * rng.choice([0.0, 0.02, 0.1, 0.15]) for i in range(240)]
    rows = [(i, v.tolist(), int(i % 40 % 3)) for i, v in enumerate(some)]
    rows += [(300, [0.0] * 64, 1), (301, None, 1), (302, [float("nan")] * 64, 1), (303, rows[0][1], None), (304, [None] * 64, 1), (305, [], 1)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array(some) / np.linalg.norm(some, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.arange(240)[:, None] % 40 % 3 == np.arange(240)[None] % 40 % 3)
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(240)] == near.sum(axis=1).tolist()
    reach = near | np.eye(240, dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert [got[i].component_id for i in range(240)] == reach.argmax(axis=1).tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(300, 306))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(none).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(13)
    errors = []
    for _ in range(40):
        v = rng.normal(size=(20, 64))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        assert (vectors.upper_bounds(v, v) >= v @ v.T - 1e-9).all()
        turned, code, factor = vectors.codes(v)
        errors.append(((code @ turned.T) / factor[:, None] - v @ v.T).mean())
    assert abs(np.mean(errors)) < 0.02


# --- token counts

def test_rollup_is_additive_and_idempotent(spark):
    store = new_folder(spark, "rollup")
    schema = "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long, docs int"
    first = spark.createDataFrame([("insert", "a", "en", "v1", None, 10, 7), ("insert", "a", None, "v1", None, 5, 7), ("insert", None, "en", "v1", None, None, 7)], schema)
    second = spark.createDataFrame([("delete", "a", None, "v1", 5, None, 7), ("revise", "a", "en", "v1", 10, 12, 7)], schema)
    assert token_counts.commit(first, store, "1")
    assert token_counts.commit(second, store, "2") and not token_counts.commit(second, store, "2")
    assert token_counts.commit(first.limit(0), store, "3")
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in token_counts.totals(spark, store).collect()}
    assert got == {("a", "en"): (1, 12), ("a", None): (0, 0), (None, "en"): (1, 0)}


# --- the pipeline

def test_rollup_counts_committed_batches_only(spark):
    store = new_folder(spark, "rollup-test")
    assert token_counts.totals(spark, store).count() == 0
    kinds = "op string, source string, lang string, tokenizer string, old_tokens long, new_tokens long, batch string"
    rows = spark.createDataFrame([("insert", "a", None, "t", None, 10, "clash")], kinds)
    assert token_counts.commit(rows, store, "1/../x =%")
    token_counts.deltas(rows).withColumn("batch", F.lit("2")).write.parquet(f"{store}/2")  # a writer that died before the mark
    assert [(r.docs, r.tokens) for r in token_counts.totals(spark, store).collect()] == [(1, 10)]
    assert [r.batch for r in token_counts.ledger(spark, store).collect()] == ["1/../x =%"]
    assert token_counts.commit(rows, store, "2") and not token_counts.commit(rows, store, "2")
    assert [(r.docs, r.tokens) for r in token_counts.totals(spark, store).collect()] == [(2, 20)]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.identify_languages(spark, docs.unionByName(docs.limit(1).withColumn("text", F.lit("123 456")).withColumn("doc_id", F.lit(-1).cast("long"))), "")
    assert kept.columns == docs.columns and kept.count() == docs.count()
    near = corpus_pipeline.dedup_near(spark, docs, "")
    sets = {}
    for r in docs.collect():
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)}
    assert {r.doc_id for r in near.select("doc_id").collect()} == set(plain_components(sets, 80).values())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > docs.count() / 2


def test_repeated_rows_are_mixed_each_by_itself(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma"], k=n))
    rows = [(i, text(100), "a") for i in range(50)] + [(7_000, text(100), "a")] * 50 + [(200 + i, text(100), "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_key", F.lit("own")).withColumn("row", F.lit(3))
    got = mixing.mix_report(docs, block=16).collect()
    assert len(got) == len(rows) and {r.source_size for r in got} == {10_000, 30_000}
    for size in (10_000, 30_000):
        taken, target = sum(r.taken for r in got if r.source_size == size), next(r.target for r in got if r.source_size == size)
        assert abs(taken - target) <= 0.05 * target and all(r.taken <= 2 * r.size for r in got)
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns and {(r["_key"], r["row"]) for r in mixed.collect()} == {("own", 3)}
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)


def test_pipeline_stages_keep_rows_and_columns(spark):
    import corpus_pipeline as cp

    rng = random.Random(6)
    text = lambda n: "\n".join(" ".join(rng.choices("the of and to in that house water".split(), k=9)) for _ in range(n))
    first, other, third = text(12), text(12), text(12)
    own = [(1, first), (2, first), (2, other), (2, other), (None, third), (None, third), (None, None), (5, "")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _key string, n_lines long, n_deleted string, lang_pred int, row long"
    rows = [(i, t, "en", "s", None if t is None else len(t), "k", 1, "d", 2, 3) for i, t in own]
    docs = spark.createDataFrame(rows, kinds)
    near = cp.dedup_near(spark, docs, "")
    assert near.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in near.collect()) == sorted((str(i), str(t)) for i, t in [(1, first), (2, other), (None, third), (None, None), (5, "")])
    for stage in (cp.identify_languages, cp.dedup_lines, cp.mix_sources):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
        assert {(r["_key"], r.n_lines, r.n_deleted, r.lang_pred, r.row) for r in out.collect()} == {("k", 1, "d", 2, 3)}
