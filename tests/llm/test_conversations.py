"""Conversation repair against exhaustive search and a plain version, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from ledgerlens.llm import conversations as c

ROWS = "conv_id long, turn long, role string, text string, times string, audit string, same long"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if k == 1:
        text = ""
    if k == 2:
        text = re.sub("[.!?]", "", text)
    return [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)


def exhausted(rows, most=2):
    """The least (cost, audit) over every string of edits with up to `most` inserts in a gap, by plain recursion; rows of (initial, fault)."""
    found = []

    def go(k, roles, cost, audit, inserts):
        if len(roles) > 1 and roles[-2:] not in ("su", "ua", "au") or roles[:1] not in ("", "s", "u"):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserts < most:
            for r in "ua":
                go(k, roles + r, cost + 2, audit + "I", inserts + 1)
        if k < len(rows):
            initial, fault = rows[k]
            go(k + 1, roles, cost + 3, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if initial in ("s", "u", "a"):
                    go(k + 1, roles + initial, cost + more, audit + "K", 0)
                for r in "ua":
                    go(k + 1, roles + r, cost + 2 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def plain_best(rows):
    """The same by a table over (row, what the grammar has read), with whole strings as weights."""
    ahead = {"": "su", "s": "u", "u": "a", "a": "u"}
    reached = {"": (0, "")}

    def better(to, g, w):
        if g not in to or w < to[g]:
            to[g] = w
            return True
        return False

    def grown(reached):
        reached, again = dict(reached), True
        while again:
            again = False
            for g, (cost, s) in list(reached.items()):
                for r in ahead[g]:
                    if r != "s":
                        again |= better(reached, r, (cost + 2, s + "I"))
        return reached

    for initial, fault in rows:
        now = {}
        for g, (cost, s) in grown(reached).items():
            better(now, g, (cost + 3, s + "D"))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for r in ahead[g]:
                    if r == initial:
                        better(now, r, (cost + more, s + "K"))
                    if r != "s":
                        better(now, r, (cost + 2 + more, s + "R"))
        reached = now
    return min(w for g, w in grown(reached).items() if g in ("", "a"))


def plain(rows, best=plain_best):
    """The contract's row of every conv_id."""
    out = []
    for conv in {r[0] for r in rows}:
        at = [x for r in rows if r[0] == conv for x in plain_damage(*r[:4])]
        same = lambda x: hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()
        at.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], same(x)))
        turns = {x[0] for x in at} - {None}
        faults, seen = [], set()
        for _, role, text in at:
            shown = text.strip(SPACE)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        marked = [(x[1][:1], f) for x, f in zip(at, faults, strict=True)]
        cost, audit = best(marked)
        written, k, state = [], 0, ""
        for edit in audit:
            want = "a" if state == "u" else "u"
            if edit == "I":
                written.append({"u": "user", "a": "assistant"}[want] + ":")
                state = want
                continue
            _, role, text = at[k]
            k += 1
            if edit != "D":
                state = role[:1] if edit == "K" else want
                written.append((role if edit == "K" else {"u": "user", "a": "assistant"}[want]) + ":" + text)
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(written).encode()).hexdigest()))
    return sorted(map(str, out))


def invented(seed, conversations, most, null=0.02):
    r = random.Random(seed)
    texts = ["Yes.", "Yes", "No!", "", " \n", "What? ", "So. ", "Ok...\t", "x" * 500, None]
    rows = []
    for conv in range(conversations):
        for turn in range(r.randint(1, most)):
            role = r.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "u", "Assistant", "svc"])
            rows.append((None if r.random() < null / 4 else conv, None if r.random() < null else turn + 2 * (r.random() < 0.1), role, r.choice(texts) if r.random() < 0.5 else f"{r.random()}."))
    return rows + rows[:7]


def test_composition_equals_exhaustive_search():
    r = random.Random(2)
    for _ in range(400):
        rows = [(r.choice("suax"), r.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(r.randint(0, 4))]
        coded = tuple(i + {"": "-", "truncated": "c"}.get(f, "g") for i, f in rows)
        want = exhausted(rows)
        assert plain_best(rows) == want
        assert c.product([c.matrix(coded, (0,))]) == want
        assert c.product([c.matrix(coded[k : k + 1], (0, 1, 2, 3)) for k in range(len(coded))]) == want


def test_blocks_of_a_long_conversation_multiply_to_the_whole():
    r = random.Random(6)
    rows = [(r.choice("uuuaaasx"), r.choice(["", "", "", "truncated", "blank"])) for _ in range(700)]
    coded = [i + {"": "-", "truncated": "c"}.get(f, "g") for i, f in rows]
    for size in (1, 3, 64, 1000):
        assert c.product([c.matrix(tuple(coded[k : k + size]), (0, 1, 2, 3)) for k in range(0, 700, size)]) == plain_best(rows)


@pytest.mark.parametrize("block", [1024, 2])
def test_rows_equal_the_plain_version(spark, block):
    rows = invented(8, 150, 9) + [(900, k % 350, "user" if k % 3 else "assistant", "again." if k % 2 else f"{k}.") for k in range(700)] + [(901, 5, "user", "Same.")] * 40
    rows = [(*r, "x", "y", 1) for r in rows]
    got = c.repaired(spark.createDataFrame(rows, ROWS).repartition(7), block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)
    assert c.repaired(spark.createDataFrame(rows, ROWS).limit(0)).count() == 0


def test_mended_conversations_alternate(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in invented(9, 60, 7)]
    out = {}
    for r in c.mended(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        out.setdefault(r["conv_id"], []).append((r["position"], r["role"]))
    for found in out.values():
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r in sorted(found)))


def test_a_conversation_of_a_third_of_all_rows_is_dealt(spark):
    """30,000 rows of one conversation over several partitions and blocks of 500 give what one block gives."""
    rows = [(7, k, "user" if k % 2 else "assistant", f"{k % 900}." if k % 13 else "cut") for k in range(30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    parts, whole = c.repaired(df, 500).collect(), c.repaired(df, 100_000).collect()
    assert parts == whole and len(parts) == 1 and parts[0]["duplicate"] > 20_000
