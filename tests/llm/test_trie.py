"""The prefix trie against all prefixes of all conversations."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fuseline.llm import prefix_trie as pt
from fuseline.llm.common import WORD_RE

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            key = f"{len((r or '').encode())}:{r or ''}{x or ''}"
            turns[c].append(((t is not None, t or 0, hashlib.md5(key.encode()).hexdigest()), (r or "", x or "")))
    turns = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute(rows):
    convs, members, children = conversations(rows), defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    saved, leaves = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(WORD_RE.findall(k[-1][1])) if k else 0
            leaves[k[:d]] += not children[k]
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(children[k]), leaves[k], saved[k], sha([c for c in m if len(convs[c]) == len(k)])) for k, m in members.items()), key=str)


def nodes(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_rows(seed, n=300, kinds=3, deep=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 2 * n), n):
        rows += [(c, t, rng.choice(["user", "assistant"][: 1 + t % 2]), " ".join(["w"] * rng.randrange(kinds))) for t in range(rng.randint(1, deep))]
    return rows


@pytest.mark.parametrize("seed, partitions, piece", [(1, 1, 1 << 20), (2, 4, 1 << 20), (3, 13, 40), (4, 60, 20)])
def test_random_conversations(seed, partitions, piece, spark):
    """Few kinds of turns: many copies and branches, cut apart anywhere."""
    rows = random_rows(seed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert nodes(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), piece)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(pt.op13_prefix_trie(spark, data)) == brute(rows)


def test_sql(spark, data, duck):
    want = sorted(duck.sql(pt.ORACLE_SQL["op13_prefix_trie"]).fetchall(), key=str)
    assert nodes(pt.op13_prefix_trie(spark, data)) == want


def test_copies_of_one_conversation(spark):
    """A third of all conversations are one, and all share their first turn."""
    rows = [(20 * c + 20, t, "user", f"first {t}") for c in range(400) for t in range(3)] + [(20 * c + 20, 3, "user", f"last {c % 200}") for c in range(200, 400)]
    assert nodes(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), 50)) == brute(rows)


def test_one_long_conversation(spark):
    rows = [(c, t, "user", "a b" if t < 2500 or c == 0 else "c") for c in (0, 20) for t in range(3000)]
    assert nodes(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute_fast(rows)


def brute_fast(rows):
    """brute() with prefixes numbered, for long conversations."""
    convs, number, members, node, word = conversations(rows), {}, defaultdict(list), {}, {0: 0}
    for c in sorted(convs):
        at = 0
        members[0].append(c)
        node[0] = (None, 0)
        for d, x in enumerate(convs[c], 1):
            new = number.setdefault((at, x), len(number) + 1)
            node[new], word[new] = (at, d), len(WORD_RE.findall(x[1]))
            members[new].append(c)
            at = new
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in sorted(node, key=lambda k: -node[k][1]):
        saved[k] += (len(members[k]) - 1) * word[k]
        leaves[k] += not children[k]
        if (up := node[k][0]) is not None:
            children[up] += 1
            saved[up] += saved[k]
            leaves[up] += leaves[k]
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    return sorted(((members[k][0], d, members[up][0] if up is not None else None, len(members[k]), children[k], leaves[k], saved[k], sha([c for c in members[k] if len(convs[c]) == d])) for k, (up, d) in node.items()), key=str)


def test_cases(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, None, "user", "b c"), (2, 5, "user", None), (2, 5, "user", "x"), (2, 5, "assistant", "x"), (None, 1, "user", "no id")]
    rows += [(-21, 0, "u", "neg"), (-20, 0, "u", "base"), (40, 0, "user", "same"), (40, 0, "user", "same"), (41, 1, "u", "w " * 200_000), (60, 0, "a", "user"), (60, 1, "au", "ser")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS key", "3 AS n", "4 AS depth", "5 AS task", "'x' AS kind")
    assert nodes(pt.prefix_trie(df)) == brute(rows)
    assert brute_fast(rows) == brute(rows)
    assert pt.prefix_trie(df.filter("false")).count() == 0 and pt.prefix_trie(df.filter("conv_id IS NULL")).count() == 0
    turnless = [(1, 0, "u", "x")]  # crc32('1') % 4 = 3: its own turn goes, and there is no conversation 0
    assert zlib.crc32(b"1") % 4 == 3 and nodes(pt.prefix_trie(spark.createDataFrame(turnless, SCHEMA))) == brute(turnless) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
