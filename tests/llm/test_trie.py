import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from brute import words
from compare import spark_rows, sql_rows

from vicinage.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, place string, n_convs string"


def slow(rows):
    """The nodes by plain loops over every conversation and its beginnings."""
    of = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in of.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].add(c)
        ends[tuple(whole)].append(c)
    out = []
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(words(x[-1][1] if x else "")) for x in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, sha))
    return sorted(out, key=str)


def fast(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_equals_sql(spark, medium):
    assert spark_rows(T.op13_prefix_trie(spark, medium)) == sql_rows(T.OP13_SQL, medium)


def test_deep_and_wide_tries(spark, monkeypatch):
    """Random tries whose paths hop between chains, with segments and blocks short enough to be crossed."""
    monkeypatch.setattr(T, "SEGMENT", 3)
    monkeypatch.setattr(T, "BLOCK", 4)
    pick, rows = random.Random(3), []
    for c in range(150):
        rows += [(c, k, "user", "ab"[pick.random() < 0.25] + " x" * (k % 3)) for k in range(pick.randrange(1, 14))]
    pick.shuffle(rows)
    assert fast(T.prefix_trie(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA))) == slow(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (5, 1, "user", "hi there"), (5, 1, "user", "hi there"), (5, 1, "bot", "hi"), (40, 0, "user", "z " * 40_000), (41, 0, "user", ""), (47, 2, None, "a b"), (-3, 0, "user", "q"), (9_007_199_254_740_993, 0, "user", "q")]
    assert fast(T.prefix_trie(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA))) == slow(rows)


def test_no_rows(spark):
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_conversations_without_turns(spark):
    """Conversations of few turns whose family has no first one are members of the root alone."""
    gone = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1]
    found = fast(T.prefix_trie(spark.createDataFrame([(c, 0, "user", "w", "", "", "") for c in gone], SCHEMA)))
    assert found == [(gone[0], 0, None, len(gone), 0, 1, 0, hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest())]


@pytest.mark.parametrize("copies", [3000])
def test_copies(spark, copies):
    """Many equal conversations: one path, whose ends are hashed over all blocks."""
    rows = [(20 * c, k, "user", f"t{k}") for c in range(copies) for k in range(4)]
    found = T.prefix_trie(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)).collect()
    assert Counter(r["n_convs"] for r in found) == Counter({copies: 5})
    ends = ",".join(str(20 * c) for c in range(copies))
    assert {r["depth"]: r["ends_sha256"] for r in found}[4] == hashlib.sha256(ends.encode()).hexdigest()
    assert {r["depth"]: r["saved_tokens"] for r in found}[0] == 4 * (copies - 1)
