"""Conversation repair against a plain search over all edits, cut into chunks of any size, and on odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from veilspark.llm import conversations as cv
from veilspark.llm import queries

ROWS = "conv_id long, turn long, role string, text string, copies int, audit string"


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of rows (turn, role, text) by keeping, for every
    row and string state of the pattern, the least (cost, audit) of all edits."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else ""
        faults.append(fault)
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # a prefix is known by the pattern state of what it gave: "" s u a
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def put(into, state, cost, audit, out):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, out)

    def inserted(now):
        for _ in range(3):
            for state, (cost, audit, out) in list(now.items()):
                for role in ("user", "assistant"):
                    if role[0] in follows[state]:
                        put(now, role[0], cost + 3, audit + "I", (*out, (role, "")))
        return now

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, out) in inserted(best).items():
            put(after, state, cost + 4, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if role[:1] and role[:1] in follows[state]:
                put(after, role[:1], cost + more, audit + "K", (*out, (role, text)))
            for new in ("user", "assistant"):
                if new[0] in follows[state]:
                    put(after, new[0], cost + more + 3, audit + "R", (*out, (new, text)))
        best = after
    cost, audit, out = min(v for k, v in inserted(best).items() if k in ("", "a"))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest


def random_rows(rng, n):
    texts = ["Yes.", "No", "", " \t", "Why?", "Well", "So!", "é.", None, "a. "]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    return [(rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}{rng.choice('.!x')}") for _ in range(n)]


def reported(spark, given, most):
    rows = [(c, *r, 1, "x") for c, own in given.items() for r in own]
    done = cv.repaired(spark.createDataFrame(rows, ROWS).repartition(7), most=most)
    return {r[0]: tuple(r)[1:] for r in cv.report(done).collect()}


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_repairs_equal_the_plain_search(spark, most):
    rng = random.Random(most)
    given = {c: random_rows(rng, rng.choice([1, 2, 3, 5, 9])) for c in range(120)}
    given[None] = random_rows(rng, 40)
    given[500] = random_rows(rng, 400)
    got = reported(spark, given, most)
    assert got == {c: plain(own) for c, own in given.items()}


def test_search_finds_the_ascii_least_of_the_cheapest():
    assert cv.search("ua", 0, 3) == (0, "KK")
    assert cv.search("aa", 0, 3) == (3, "RK") and cv.search("-x", 0, 0) == (8, "DD")
    rng = random.Random(3)
    for _ in range(60):
        codes = "".join(rng.choices("suaxSUAX-", k=rng.randint(0, 4)))
        for begin in cv.STATES:
            for end in cv.STATES:
                assert cv.search(codes, begin, end) == exhaustive(codes, begin, end)


def exhaustive(codes, begin, end):
    """The least (cost, audit) by trying all edits, with up to two inserts before a row."""
    found, todo = [], [(0, "", 0, begin, 0)]
    while todo:
        cost, audit, at, state, inserts = todo.pop()
        if at == len(codes):
            found += [(cost, audit)] if state == end else []
            continue
        for letter, more, taken, to in cv.moves(codes[at], state):
            if letter != "I" or inserts < 2:
                todo.append((cost + more, audit + letter, at + taken, to, 0 if taken else inserts + 1))
    return min(found, default=None)


def test_dropped_conversations_stay_and_rows_come_out_in_order(spark):
    rows = [(1, 0, "user", "Hi.", 0, ""), (2, 5, "user", "Hi.", 2, ""), (2, 7, "user", "Who?", 1, ""), (2, None, "system", "Be kind.", 1, "")]
    done = cv.repaired(spark.createDataFrame(rows, ROWS), F.col("copies"))
    got = {r["conv_id"]: r for r in cv.report(done).collect()}
    assert tuple(got[1]) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # system, user, its copy, user: the copy goes and the last one becomes the answer
    assert tuple(got[2])[1:8] == (1, 0, 1, 0, 2, 7, "KKDR")
    out = [(r["role"], r["text"]) for r in cv.repaired_rows(done).filter("conv_id = 2").orderBy("part", "seq", "at").collect()]
    assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest() == got[2]["repaired_sha256"]
    assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in out))


def test_empty_table(spark):
    assert cv.report(cv.repaired(spark.createDataFrame([], ROWS))).count() == 0


def test_query_equals_the_plain_search_on_the_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    given = {}
    for r in table:
        own = given.setdefault(r["conv_id"], [])
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (r["conv_id"], r["turn"])).encode()) % 20
        role, text = "user" if kind == 4 else r["role"], " " if r["text"] is None else r["text"]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(r["turn"], role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_repair_conversations(spark, "/root/testdata/sf0.001").collect()}
    assert got == {c: plain(own) for c, own in given.items()}
