"""Operators on conversations: the prefix trie and the repair of their structure."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from cohortia.llm import groups, prefix_trie
from cohortia.llm import structure_repair as sr

NAMES = "conv_id bigint, turn bigint, role string, text string, n int, parent string, cls double, rest string, kind int, code string, audit int, w int, c string, t int, m string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2.0, "r", 3, "c", 4, 5, "c", 6, "m") for r in rows], NAMES)


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


# --- 11 prefix trie --------------------------------------------------------------------------


def brute_trie(rows):
    of = {}
    for c, turn, role, text, in rows:
        if c is not None:
            of.setdefault(c, []).append((turn is not None, turn or 0, role or "", digest(text or ""), text or ""))
    for c in of:
        of[c] = [(r, t) for _, _, r, _, t in sorted(of[c])]
    new = {}
    for c, own in of.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20
        new[c] = of.get(c - base, [])[:h] + own[h:]
    members = {}
    for c, t in new.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = set()
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(re.findall(prefix_trie.WORD, p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in ids if len(new[c]) == len(path))))
        up = min(members[path[:-1]]) if path else None
        kids = sum(len(p) == len(path) + 1 for p in below)
        out.add((min(ids), len(path), up, len(ids), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def chats(seed, n):
    r = random.Random(seed)
    words = ["yes", "no  more", "why\tnot", "", "é è", "a b c d"]
    rows = []
    for c in r.sample(range(-45, 130), n):
        for turn in range(r.choice([1, 1, 2, 3, 5, 7])):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(words[: r.choice([1, 3, 6])])))
    return rows


def nodes(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("seed", "heavy"), [(1, 4096), (2, 4), (3, 1)])
def test_trie_against_brute_force(spark, monkeypatch, seed, heavy):
    monkeypatch.setattr(groups, "HEAVY", heavy)  # classes of few and of many members
    rows = chats(seed, 90)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(conversations(spark, rows).repartition(3))))
    assert nodes(got) == brute_trie(rows)


def test_trie_cases(spark):
    copies = [(200 + 20 * i, t, "user", f"turn {t}") for i in range(30) for t in range(6)]
    rows = copies + [(None, 0, "user", "nobody's"), (3, None, None, None), (3, None, None, None), (3, 1, "user", "x"), (3, 1, "assistant", "x"), (3, 1, "assistant", "w"), (7, 5, "user", "q " * 50_000)]
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(conversations(spark, rows))))
    assert nodes(got) == brute_trie(rows)
    alone = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(conversations(spark, [(6, 0, "user", "hi")]))))
    assert nodes(alone) == brute_trie([(6, 0, "user", "hi")])
    empty = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(conversations(spark, []))))
    assert empty.count() == 0 and empty.columns == got.columns


def test_ends_are_hashed_over_many_chunks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(1, 5, i) for i in range(-40, 200)] + [(2, 5, 3)] + [(1, 6, i) for i in range(10)]
        got = prefix_trie.ends_of(spark.createDataFrame(rows, "depth int, cls bigint, conv_id bigint").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for d, c, i in sorted(rows):
        want.setdefault((d, c), []).append(str(i))
    assert sorted(map(tuple, got)) == sorted((d, c, hashlib.sha256(",".join(v).encode()).hexdigest()) for (d, c), v in want.items())


# --- 12 structure repair ---------------------------------------------------------------------


def brute_repair(rows):
    """Uniform-cost search with whole audits as strings."""
    queue, seen = [(0, "", 0, 0)], set()
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    while True:
        cost, audit, i, state = heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit
        want = "a" if state == 2 else "u"
        heappush(queue, (cost + 2, audit + "I", i, after[state, want]))
        if i < len(rows):
            initial, fault = rows[i]
            heappush(queue, (cost + 3, audit + "D", i + 1, state))
            if fault in ("", "truncated"):
                more = int(fault == "truncated")
                heappush(queue, (cost + 2 + more, audit + "R", i + 1, after[state, want]))
                if (state, initial) in after:
                    heappush(queue, (cost + more, audit + "K", i + 1, after[state, initial]))


def test_a_star_against_uniform_cost():
    r = random.Random(4)
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(3000):
        rows = [(r.randrange(4), r.randrange(4)) for _ in range(r.randrange(12))]
        assert sr.repair(bytes(4 * i + f for i, f in rows)) == brute_repair([("sua?"[i], names[f]) for i, f in rows])


def test_audits_compare_as_strings():
    r = random.Random(2)
    made, used = [sr.Audit()], set()
    while len(made) < 400:
        up, letter = r.choice(made[-30:]), r.choice("DIKR")
        if (up, letter) not in used:  # a node is expanded once
            used.add((up, letter))
            made.append(sr.Audit(letter, up))
    for _ in range(3000):
        a, b = r.choice(made), r.choice(made)
        if str(a) != str(b):
            assert (a < b) == (str(a) < str(b))


def brute_structure(rows):
    blank = " \t\n\x0b\x0c\r"
    of = {}
    for c, turn, role, text in rows:
        own = of.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn is not None, turn or 0, "user" if kind == 4 else role, digest(text), text)
        own += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = set()
    for c, own in of.items():
        own.sort()
        faults, seen = [], set()
        for _, _, role, _, text in own:
            last = text.strip(blank)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
            seen.add((role, text))
        initials = [x[2][:1] for x in own]
        cost, audit = brute_repair(list(zip(initials, faults)))
        made, i = [], 0
        for letter in audit:
            want = "assistant" if made and made[-1][0][:1] == "u" else "user"
            if letter == "I":
                made.append((want, ""))
                continue
            if letter != "D":
                made.append((own[i][2] if letter == "K" else want, own[i][4]))
            i += 1
        turns = [x[1] for x in own if x[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        text = "\n".join(f"{a}:{b}" for a, b in made)
        out.add((c, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def structures(seed):
    r = random.Random(seed)
    texts = ["Yes.", "No! ", "why", "", " \t\r\n", "ok?\x0b", "é…", "a. ", "same."]
    rows = []
    for c in range(-6, 60):
        at = r.randrange(5)
        for turn in range(r.choice([1, 2, 4, 6, 9])):
            rows.append((c, at, ["user", "assistant"][turn % 2] if r.random() < 0.7 else r.choice(["system", "user", "assistant", "tool", "", None]), r.choice(texts)))
            at += r.choice([1, 1, 1, 2])
    rows += [(70, None, "user", "x."), (70, None, None, None), (70, None, "user", None), (None, 1, "user", "q."), (None, None, "assistant", "r.")]
    return rows + [(71, 3, "user", "long. " * 40_000), (71, 4, "assistant", "b."), (71, 4, "assistant", "b."), (71, 4, "assistant", "a.")]


@pytest.mark.parametrize("seed", [1, 2])
def test_structure_against_brute_force(spark, seed):
    rows = structures(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # conversations over many batches
    try:
        got = [tuple(r) for r in sr.repaired(conversations(spark, rows).repartition(3)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == brute_structure(rows)


def test_structure_cases(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = sr.repaired(conversations(spark, [(dropped, 0, "user", "gone")]))
    assert [tuple(r) for r in out.collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    empty = sr.repaired(conversations(spark, []))
    assert empty.count() == 0 and empty.columns == out.columns


def test_long_conversations_are_repaired_in_bounded_steps():
    r = random.Random(5)
    cost, audit = sr.repair(bytes(r.randrange(16) for _ in range(20_000)))
    assert sum(x != "I" for x in audit) == 20_000 and cost > 0
