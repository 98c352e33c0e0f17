"""The suffix automaton against brute force on random texts, and on odd inputs."""

import random
import re

import pytest

from veilspark.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, window):
    """(hit word places, item ids) by trying every window at every place."""
    own, hit, ids = words(text), set(), set()
    for name, item in items:
        w = words(item)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            for q in range(len(own) - k + 1):
                if own[q : q + k] == w[p : p + k]:
                    hit |= set(range(q, q + k))
                    ids.add(name)
    return hit, sorted(str(i) for i in ids if i is not None)


def made(rng, letters, n, most):
    return [" ".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("seed,letters,window", [(1, "abc", 4), (2, ["Ab", "b'", "ç-É", "d1"], 3), (3, "abcdefghij", 2), (4, "ab", 10)])
def test_leaks_equal_every_window_tried(spark, seed, letters, window):
    rng = random.Random(seed)
    items = [(i, t) for i, t in enumerate(made(rng, letters, 12, 14))] + [(None, "zz yy xx"), (7, "qq rr ss tt"), (3, None)]
    docs = [(i, t) for i, t in enumerate(made(rng, [*letters, "zz", "yy", "xx"], 40, 40))] + [(None, None), (5, ""), (5, "a b c")]
    got = dc.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), dc.Limits(window), block=30
    ).collect()
    assert len(got) == len(docs)
    for row in got:
        hit, ids = plain(row["text"], items, window)
        assert {w for s in row["leak"]["spans"] for w in range(s["begin"], s["end"])} == hit
        assert (row["leak"]["n_words"], row["leak"]["n_hit"], row["leak"]["items"]) == (len(words(row["text"])), len(hit), ids)
        assert all(a["end"] < b["begin"] for a, b in zip(row["leak"]["spans"], row["leak"]["spans"][1:]))


def test_longest_match_is_longer_than_a_window():
    rng = random.Random(9)
    item = [f"w{i}".encode() for i in range(40)]
    one = dc.Automaton(dc.build([("a", item, True), ("b", rng.sample(item, 40), True)], 10))
    spans, items, longest = one.read([b"w0", b"x", *item[3:31], b"y", *item[:5]])
    assert (spans, {one.names[i] for i in items}, longest) == ([(2, 30)], {"a"}, 28)


def test_an_automaton_never_exceeds_its_block_and_long_items_lose_no_window(spark):
    text = " ".join(f"n{i}" for i in range(1000))
    items = spark.createDataFrame([("x", text), ("y", "n5 m")], "item_id string, text string")
    packed = [dc.pickle.loads(r["packed"]) for r in dc.automata(items, 10, 64).collect()]
    assert len(packed) > 15 and all(len(p["words"]) <= 64 for p in packed)
    docs = spark.createDataFrame([(1, text), (2, " ".join(f"n{i}" for i in range(500, 512)))], "doc_id long, text string")
    rows = {r["doc_id"]: r["leak"] for r in dc.leaks(docs, items, block=64).collect()}
    assert (rows[1]["n_hit"], rows[1]["items"], rows[2]["n_hit"]) == (1000, ["x"], 12)


def test_spans_go_from_the_text_and_mostly_hit_documents_go_whole(spark):
    item = "One two, three four FIVE six seven eight nine ten eleven."
    docs = [
        (1, f"Before it. {item} After  it,\nmuch is said that no item holds, and more of it follows here. End of it.", "kept", 1),
        (2, item, "gone", 2),
        (3, "one two three four five six seven eight nine", "short of a window", 3),
        (4, None, None, None),
        (None, "", "empty", 4),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string, leak string, n_words long")
    out = dc.decontaminate(table, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == table.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == {1, 3, 4, None}
    assert got[1]["text"] == "Before it. . After  it,\nmuch is said that no item holds, and more of it follows here. End of it."
    assert (got[1]["leak"], got[1]["n_words"], got[3]["text"], got[4]["text"], got[None]["text"]) == ("kept", 1, docs[2][1], None, "")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a " * 50_000)], "doc_id long, text string")
    (row,) = dc.leaks(docs, items).collect()
    assert (row["leak"]["n_words"], row["leak"]["n_hit"], row["leak"]["items"]) == (50_000, 0, [])
    (row,) = dc.leaks(docs, spark.createDataFrame([(1, "a " * 3000)], "item_id long, text string")).collect()
    assert (row["leak"]["n_hit"], row["leak"]["longest"]) == (50_000, 3000)
