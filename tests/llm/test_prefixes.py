"""The prefix trie against a plain rebuilding of every conversation, on edge rows and a very long one."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from linewright.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(set)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
        ends[turns].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        own_saved = (len(held) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own_saved
            leaves[node[:d]] += node not in children
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(held), len(n), min(members[n[:-1]]) if n else None, len(held), children[n], leaves[n], saved[n], digest(ends.get(n, [])))
        for n, held in members.items()
    )


def found(spark, rows, clash=False):
    frame = spark.createDataFrame(rows, SCHEMA)
    if clash:
        frame = frame.withColumns({n: F.lit(n) for n in ("base", "digest", "k1", "depth", "owner", "n_bytes", "_n", "id", "a b", "x.y")})
    return prefixes.trie(spark, frame)


def collected(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


def made(n, seed, words=3):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-40, 400), n):
        for turn in range(r.choice([1, 2, 3, 8, 12])):
            rows.append((c, turn, r.choice(["user", "system"]), "é" * r.randrange(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_families(spark, seed):
    rows = made(120, seed)
    assert collected(found(spark, rows, clash=True)) == plain(rows)


def test_edge_rows(spark):
    rows = [
        (0, 1, "user", "a"), (0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "b"), (None, 0, "user", "a"), (None, None, None, None),
        (6, 0, "user", "a"), (7, 3, "user", ""), (7, 2, "", "user"), (-3, 0, "user", "a"), (-3, 1, "x", None), (11, None, None, None), (13, 0, "user", "x" * 200_000),
    ] + [(c, t, "user", "same") for c in range(1000, 1100) for t in range(10)] + [(20, t, "user", str(t % 7)) for t in range(2500)]
    assert collected(found(spark, rows)) == plain(rows)
    assert collected(found(spark, [])) == []


def test_more_nodes_and_ids_than_a_task_holds(spark, monkeypatch):
    rows = made(100, 3, words=2)
    want = plain(rows)
    assert collected(found(spark, rows)) == want
    tries = prefixes._Family()
    monkeypatch.setattr(prefixes, "HELD", 4)
    monkeypatch.setattr(prefixes, "PACK", 2)
    monkeypatch.setattr(prefixes, "BLOCK", 3)
    assert collected(found(spark, rows)) == want
    assert tries.nodes == {}


def test_ladder_of_branches(spark):
    """Each conversation leaves the one before it a turn later: the trie is deep, the rounds stay few."""
    rows = [(5 * c, t, "user", f"step {t}") for c in range(60) for t in range(c)] + [(5 * c, c, "user", f"end {c}") for c in range(60)]
    assert collected(found(spark, rows)) == plain(rows)


def test_turns_of_nodes(spark):
    rows = made(60, 4)
    frame = spark.createDataFrame(rows, SCHEMA)
    turned = prefixes.with_turns(prefixes.trie(spark, frame), frame).collect()
    assert len(turned) == len(plain(rows))
    assert all((r["text"] is None) == (r["depth"] == 0) for r in turned)


def test_equals_sql(spark, tiny):
    rows = made(150, 5)
    connection = duckdb.connect()
    connection.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(connection.sql(prefixes.SQL).fetchall(), key=str) == sorted(plain(rows), key=str)
