"""Prefix trie of conversations, merged family first.

A conversation c belongs to the family of its base b = c - c % 5 (the remainder has the
sign of c, as in SQL). It is rebuilt from the first h original turns of b (h is the
unsigned crc32 of c in decimal, modulo 9) and its own turns after its first h. The turns
of a family meet in one place, base first: Spark sorts them (and spills), a task streams
them, rebuilds every member, and combines the nodes that members share. Only these
combined nodes are shuffled and merged by key. A node's key is a 128-bit chained digest of
its turns, so no texts travel.

Subtree totals need no walk over the trie. Every node belongs to the path of the member
whose id has the smallest rank (a bijective hash); the nodes of a path are consecutive
depths of one conversation. Totals are suffix sums along paths, and the total of a whole
path is added where the path leaves another one. A round moves all such totals up by one
path. Ranks are as good as random, so the number of rounds is about the logarithm of the
number of conversations at most, however deep the trie is.

Cases: null turns come first; turns of equal number stand in the order of the digest of
role and text, so equal rows are turns of their own in any order. A null role or text is
empty. Rows with a null conv_id belong to no conversation. A conversation of any length is
streamed; suffix sums run in blocks of ``BLOCK`` depths. An empty table gives no rows, not
even the root. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.llm import tables

FAMILY = 5
CARRIED = 9
BLOCK = 1024
#: Ids joined to one row before they meet, and combined nodes that a task holds at most.
PACK = 4096
HELD = 65_536

ROOT = (0, 0)
_MASK = (1 << 64) - 1
_NODES = "k1 long, k2 long, p1 long, p2 long, depth long, n_bytes long, n_convs long, conv_id long, owner long, ends array<long>"
_KEY = ["k1", "k2"]
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def carried_turns(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % CARRIED


def rank(conv_id: int) -> int:
    """A bijection of signed 64-bit numbers whose order has nothing to do with theirs."""
    x = conv_id & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def _turns(conversations: DataFrame) -> DataFrame:
    """A row of fixed size for each turn, families together and their bases first."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("long")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        (conv - conv % FAMILY).alias("base"),
        conv.alias("conv_id"),
        F.col("turn").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest")


class _Family:
    """The small trie of one family; ``full`` nodes are handed on early, the merge adds them up."""

    def __init__(self) -> None:
        self.base: int | None = None
        self.base_turns: list[tuple[bytes, int]] = []
        self.conv: int | None = None
        self.nodes: dict[tuple[int, int], list] = {}

    def open(self, base: int, conv: int) -> None:
        if base != self.base:
            self.base, self.base_turns = base, []
        self.conv, self.rank, self.carried, self.seen = conv, rank(conv), carried_turns(conv), 0
        self.at, self.depth, self.is_base = ROOT, 0, conv == base
        self._meet(ROOT, ROOT, 0)
        if not self.is_base:
            for digest, n_bytes in self.base_turns[: self.carried]:
                self._step(digest, n_bytes)

    def turn(self, digest: bytes, n_bytes: int) -> None:
        if self.is_base:
            if self.seen < CARRIED - 1:
                self.base_turns.append((digest, n_bytes))
            self._step(digest, n_bytes)
        elif self.seen >= self.carried:
            self._step(digest, n_bytes)
        self.seen += 1

    def close(self) -> None:
        if self.conv is not None:
            self.nodes[self.at][-1].append(self.conv)
            self.conv = None

    def _step(self, digest: bytes, n_bytes: int) -> None:
        above = self.at
        self.at = struct.unpack("<qq", hashlib.blake2b(struct.pack("<qq", *above) + digest, digest_size=16).digest())
        self.depth += 1
        self._meet(self.at, above, n_bytes)

    def _meet(self, key: tuple[int, int], above: tuple[int, int], n_bytes: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            self.nodes[key] = [*key, *above, self.depth, n_bytes, 1, self.conv, self.rank, []]
            return
        node[6] += 1
        node[7] = min(node[7], self.conv)
        node[8] = min(node[8], self.rank)

    def take(self) -> list[list]:
        """All nodes so far. The one that an open conversation stands on goes on with no members of its own."""
        out, self.nodes = list(self.nodes.values()), {}
        if self.conv is not None:
            here = next(n for n in out if (n[0], n[1]) == self.at)
            self.nodes[self.at] = [*here[:6], 0, self.conv, self.rank, []]
        return out


def _family_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family, out = _Family(), []

    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 9 + [pa.list_(pa.int64())]
        names = [part.split()[0] for part in _NODES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for rows in batches:
        columns = [rows.column(n).to_pylist() for n in ("base", "conv_id", "digest", "n_bytes")]
        for base, conv, digest, n_bytes in zip(*columns, strict=True):
            if conv != family.conv:
                family.close()
                if base != family.base:
                    out += family.take()
                    if len(out) >= HELD:
                        yield batch(out)
                        out = []
                family.open(base, conv)
            family.turn(digest, n_bytes)
            if len(family.nodes) >= HELD:
                yield batch(family.take())
    family.close()
    out += family.take()
    if out:
        yield batch(out)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the ascending ids of a node, up to PACK of them, to one text."""
    key, ids, out = None, [], []

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["k1", "k2", "first", "ids"])

    for rows in batches:
        for k1, k2, one in zip(*(rows.column(n).to_pylist() for n in ("k1", "k2", "id")), strict=True):
            if key != (k1, k2) or len(ids) == PACK:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (k1, k2), []
            ids.append(one)
        if len(out) >= 1024:
            yield batch()
            out.clear()
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
    if out:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the packs of each node, in order; only the state of one digest is held."""
    key, state, out = None, None, []

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["k1", "k2", "ends_sha256"])

    for rows in batches:
        for k1, k2, ids in zip(*(rows.column(n).to_pylist() for n in ("k1", "k2", "ids")), strict=True):
            if key == (k1, k2):
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        if len(out) >= HELD:
            yield batch()
            out.clear()
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield batch()


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The combined nodes of each family: key, parent's key, depth, bytes of the last text, members, ends."""
    return _turns(conversations).mapInArrow(_family_tries, _NODES)


def _merged(family: DataFrame) -> DataFrame:
    same = [F.min(c).alias(c) for c in ("p1", "p2", "depth", "n_bytes", "conv_id", "owner")]
    return family.groupBy(*_KEY).agg(*same, F.sum("n_convs").alias("n_convs"))


def end_digests(family: DataFrame) -> DataFrame:
    """The digest of the ids that end at a node, for nodes that have any.

    SHA-256 must read the ids of a node in order, so one task hashes them, as a stream of
    packs; ranges of ids make the packs in parallel before.
    """
    ids = family.select(*_KEY, F.explode("ends").alias("id")).repartitionByRange("id").sortWithinPartitions(*_KEY, "id")
    packs = ids.mapInArrow(_packs, "k1 long, k2 long, first long, ids string")
    return packs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def _linked(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Nodes with the number of their children and their parent's conversation and path."""
    kids = nodes.filter(F.col("depth") > 0).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    counted = tables.cut(spark, nodes.join(kids, _KEY, "left").fillna(0, ["n_children"]), "trie-counted")
    above = counted.filter(F.col("n_children") > 0).select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("parent_owner"), F.col("n_children").alias("_n")
    )
    below = tables.attach(counted.filter(F.col("depth") > 0), above, ["p1", "p2"], counted.count())
    return tables.cut(spark, below.unionByName(counted.filter(F.col("depth") == 0), allowMissingColumns=True), "trie-linked")


def _own(name: str) -> Column:
    return {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}[name]


def _from_other_paths(spark: SparkSession, linked: DataFrame) -> DataFrame:
    """(owner, depth, more_leaves, more_saved): what whole paths add where they leave another one."""
    leaves_it = F.col("parent_owner") != F.col("owner")
    paths = linked.groupBy("owner").agg(
        F.sum(_own("leaves")).alias("leaves"),
        F.sum(_own("saved")).alias("saved"),
        F.max(F.when(leaves_it, F.col("parent_owner"))).alias("up"),
        (F.min("depth") - 1).alias("up_depth"),
    )
    paths = tables.cut(spark, paths.filter(F.col("up").isNotNull()), "trie-paths")
    totals = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]

    def arrive(rows: DataFrame) -> DataFrame:
        return tables.cut(spark, rows.groupBy(F.col("up").alias("owner"), F.col("up_depth").alias("depth")).agg(*totals), "trie-arrived")

    found = [arrive(paths)]
    while not found[-1].isEmpty():
        risen = found[-1].groupBy("owner").agg(*totals).join(paths.select("owner", "up", "up_depth"), "owner")
        found.append(arrive(risen))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("owner", "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def _subtree_totals(spark: SparkSession, linked: DataFrame) -> DataFrame:
    more = _from_other_paths(spark, linked)
    block = F.floor(F.col("depth") / BLOCK)
    here = linked.join(more, ["owner", "depth"], "left").withColumns(
        {
            "_block": block,
            "_leaves": _own("leaves") + F.coalesce("more_leaves", F.lit(0)),
            "_saved": _own("saved") + F.coalesce("more_saved", F.lit(0)),
        }
    )
    below = Window.partitionBy("owner", "_block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    deeper = Window.partitionBy("owner").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = here.groupBy("owner", "_block").agg(F.sum("_leaves").alias("l"), F.sum("_saved").alias("s"))
    blocks = blocks.select("owner", "_block", F.sum("l").over(deeper).alias("_l"), F.sum("s").over(deeper).alias("_s")).filter(F.col("_l").isNotNull())
    summed = here.withColumns({"_leaves": F.sum("_leaves").over(below), "_saved": F.sum("_saved").over(below)})
    summed = summed.join(blocks, ["owner", "_block"], "left")
    return summed.withColumns(
        {"n_leaves": F.col("_leaves") + F.coalesce("_l", F.lit(0)), "saved_tokens": F.col("_saved") + F.coalesce("_s", F.lit(0))}
    )


def trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row for each node: its key and its parent's key (two longs each), members and totals of its subtree."""
    family = tables.cut(spark, family_nodes(conversations), "trie-family")
    linked = _linked(spark, tables.cut(spark, _merged(family), "trie-nodes"))
    nodes = _subtree_totals(spark, linked).join(end_digests(family), _KEY, "left")
    return nodes.select(
        *_KEY, "p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"),
    )


def rebuild(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text): the turns of every rebuilt conversation, depth from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("long")
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    own = conversations.filter(F.col("conv_id").isNotNull()).select(conv.alias("conv_id"), "turn", role.alias("role"), text.alias("text"), digest.alias("_d"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "_d"))).drop("turn", "_d")
    heads = own.groupBy("conv_id").agg(F.count("*").alias("_has")).withColumn("_base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = heads.withColumn("_h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % CARRIED)
    lengths = heads.select(F.col("conv_id").alias("_base"), F.col("_has").alias("_base_has"))
    heads = heads.join(lengths, "_base", "left").withColumn("_taken", F.least("_h", F.coalesce("_base_has", F.lit(0))))
    opening = own.filter((F.col("place") < CARRIED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "_base")
    taken = heads.join(opening, "_base").filter(F.col("place") <= F.col("_taken")).select("conv_id", F.col("place").alias("depth"), "role", "text")
    kept = heads.join(own, "conv_id").filter(F.col("place") > F.col("_h"))
    return taken.unionByName(kept.select("conv_id", (F.col("place") - F.col("_h") + F.col("_taken")).alias("depth"), "role", "text"))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of ``trie`` with the role and text of their last turn (null for the root)."""
    return nodes.join(rebuild(conversations), ["conv_id", "depth"], "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie(spark, tables.read(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id
), heads AS (
  SELECT c.conv_id AS c, c.conv_id - c.conv_id % 5 AS b,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c.conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
  FROM sizes c
), taken AS (SELECT heads.*, least(h, coalesce(s.n, 0)) AS t FROM heads LEFT JOIN sizes s ON s.conv_id = b
), turns AS (
  SELECT c, i AS d, role, text FROM taken JOIN own ON own.conv_id = b AND i <= t
  UNION ALL
  SELECT c, i - h + t, role, text FROM taken JOIN own ON own.conv_id = c AND i > h
), members AS (
  SELECT c, d, strlen(text) AS n_bytes, md5(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS key
  FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM heads
), nodes AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, min(n_bytes) AS n_bytes FROM members GROUP BY key, d
), above AS (
  SELECT n.key, m.key AS up, m.d AS up_d, n.d, (n.n_convs - 1) * n.n_bytes AS saved FROM nodes n JOIN members m ON m.c = n.conv_id AND m.d <= n.d
), parents AS (SELECT a.key, p.key AS up, p.conv_id AS parent_conv_id FROM above a JOIN nodes p ON p.key = a.up WHERE a.up_d = a.d - 1
), kids AS (SELECT up, count(*) AS n FROM parents GROUP BY up
), totals AS (SELECT a.up, sum(a.saved) AS saved, count(*) FILTER (WHERE k.up IS NULL) AS leaves FROM above a LEFT JOIN kids k ON k.up = a.key GROUP BY a.up
), ends AS (
  SELECT m.key, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS digest
  FROM (SELECT c, max(d) AS d FROM members GROUP BY c) last JOIN members m ON m.c = last.c AND m.d = last.d GROUP BY m.key
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
       t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN parents p ON p.key = n.key LEFT JOIN kids k ON k.up = n.key JOIN totals t ON t.up = n.key LEFT JOIN ends e ON e.key = n.key
"""
