"""The trie against prefixes kept in dictionaries: nodes, parents, leaves, savings, ends; long and hot conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessitura.llm import prefix_trie as P
from tessitura.llm._shared import materialize
from tessitura.llm.queries import op13_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, pos int, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", 5, "mine") for r in rows], SCHEMA)


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs, group=5, heads=9):
    h = {c: zlib.crc32(str(c).encode()) % heads for c in convs}
    return {c: convs.get(c - c % group, [])[: h[c]] + own[h[c] :] for c, own in convs.items()}


def brute(convs):
    """Nodes as (conv_id, depth, parent, n_convs, n_children, n_leaves, saved, n_ends, ends_sha256)."""
    members = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in cs if len(convs[c]) == len(p))
        leaves = sum(all(len(convs[c]) == len(q) for c in members[q]) for q in below)
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below)
        children = sum(len(q) == len(p) + 1 for q in below)
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children, leaves, saved, len(ends), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def built(turns, members):
    got = [tuple(r) for r in P.build(turns, members).collect()]
    assert len(got) == len(set(got))
    return set(got)


def plain(spark, rows):
    turns = P.ordered_turns(frame(spark, rows))
    return built(turns, materialize(P.members_of(turns), "t"))


def made(seed, n=60, texts=("", "a", "ä b", "c" * 100, "c" * 99 + "d")):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(150), n):
        for t in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((c, None if r.random() < 0.1 else t if r.random() < 0.8 else 1, r.choice(["user", "bot", None]) if r.random() < 0.3 else "user", r.choice(texts) if r.random() < 0.3 else texts[min(t, 4)]))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, seed):
    rows = made(seed)
    assert plain(spark, rows) == brute(in_order(rows))
    turns, members = P.rebased(P.ordered_turns(frame(spark, rows)), 5, 9)
    assert built(turns, members) == brute(rebuilt(in_order(rows)))


def test_hot_and_long(spark, monkeypatch):
    """A turn that nearly all begin with, copies in hundreds, and a conversation over many partitions and blocks."""
    monkeypatch.setattr(P, "BLOCK", 7)
    monkeypatch.setattr(P, "CHUNK", 50)
    rows = [(c, t, "user", x) for c in range(400) for t, x in enumerate(["hello", "again"] + ([f"w{c % 3}"] if c % 4 else []))]
    rows += [(1000, t, "user", f"turn {t}") for t in range(900)] + [(1001, t, "user", f"turn {t}") for t in range(3)]
    assert plain(spark, rows) == brute_wide(in_order(rows))


def brute_wide(convs):
    """As brute, for many nodes: sums go up from each node."""
    members = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for q, cs in sorted(members.items(), key=lambda m: -len(m[0])):
        saved[q] += (len(cs) - 1) * (len(q[-1][1].encode()) if q else 0)
        leaves[q] += not children[q]
        if q:
            children[q[:-1]] += 1
            leaves[q[:-1]] += leaves[q]
            saved[q[:-1]] += saved[q]
    out = set()
    for p, cs in members.items():
        ends = sorted(c for c in cs if len(convs[c]) == len(p))
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], len(ends), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (-3, 1, None, None), (-3, None, "user", "first"), (7, 0, "user", "x"), (7, 0, "user", "x"), (8, 0, "user", "x"), (9, 5, "", ""), (9, 5, None, "")]
    assert plain(spark, rows) == brute(in_order(rows))
    assert plain(spark, rows[:1]) == set() == plain(spark, [])
    turns, members = P.rebased(P.ordered_turns(frame(spark, [])), 5, 9)
    assert built(turns, members) == set()


def test_turnless(spark):
    """Conversations that lose all their turns are members of the root and end there."""
    convs = {c: [("user", "only")] for c in (1, 2, 3, 6)}  # their bases are absent
    turns, members = P.rebased(P.ordered_turns(frame(spark, [(c, 0, *s[0]) for c, s in convs.items()])), 5, 9)
    want = rebuilt(convs)
    assert not all(want.values()) and built(turns, members) == brute(want)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in op13_conversation_trie(spark, sf).collect()}
    assert got == {r[:7] + r[8:] for r in brute(rebuilt(in_order(rows)))}
