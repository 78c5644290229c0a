"""Conversation prefix trie in balanced parentheses, shard by shard.

A node of the trie is a distinct sequence of first turns. Its identity is two 64-bit
hashes of the sequence: the exclusive or, over its turns, of hashes of (position, role,
text), a prefix sum along the conversation. Texts are hashed where they are read and go
no further.

1. Nodes are the groups of equal (depth, identity) over all conversations, combined
   before the shuffle: members, smallest member, bytes of the last text, and weight,
   the turns of all members.
2. A node's class is how often its weight exceeds LIMIT, in powers of FAN. Classes fall
   along a path, so the nodes of one class form subtrees, each named by its top. Light
   subtrees (class 0) hold at most LIMIT rows; they are dealt to shards whole.
3. Every shard writes its forest as balanced parentheses. Range minima of the excess
   over blocks of BLOCK bits, and a tree over them, find the close of every open
   parenthesis; that delimits its subtree. Leaf pairs "()" counted by rank, and a
   cumulative array of savings, give the subtree's leaves and savings.
4. Spines, which light subtrees share, are the nodes of higher classes. The tops of all
   subtrees that hang from one spine node are summed and stand in its shard as one leaf
   pair that carries their leaves and savings. So classes merge upwards, one after the
   other, a handful even for very many conversations: a subtree of a class has at most
   FAN leaves of its own, however many conversations share a turn.

Only row counts and the highest class reach the driver.

Defined cases: null role and text are empty; rows of a null conv_id belong to no
conversation and are left out; turns are ordered by turn, null first, then by the
hashes of role and text, and rows that repeat are turns of their own; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscript.llm.common import table, travels
from folioscript.operators import ordered
from folioscript.session import cut_lineage

travels(__name__)
LIMIT, FAN = 1 << 17, 1 << 10
BLOCK = 64
ID_BLOCK = 4096  # conversation ids gathered in one string


class Parentheses:
    """A balanced sequence with range minima of its excess."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.n = len(opens)
        excess = np.cumsum(np.where(opens, 1, -1))
        blocks = max(1, -(-self.n // BLOCK))
        self.excess = np.full(blocks * BLOCK, np.iinfo(np.int64).max // 2, np.int64)
        self.excess[: self.n] = excess
        self.blocks = self.excess.reshape(blocks, BLOCK)
        self.minima = [self.blocks.min(axis=1)]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            if len(low) % 2:
                low = np.append(low, np.iinfo(np.int64).max // 2)
            self.minima.append(low.reshape(-1, 2).min(axis=1))

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each open one: the first behind it with an excess one lower."""
        out = np.empty(len(at), np.int64)
        for lo in range(0, len(at), 1 << 14):
            out[lo : lo + (1 << 14)] = self._close(at[lo : lo + (1 << 14)])
        return out

    def _close(self, at: np.ndarray) -> np.ndarray:
        target = self.excess[at] - 1
        block = at // BLOCK
        hit = (self.blocks[block] <= target[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        out = block * BLOCK + hit.argmax(axis=1)
        open_ = np.flatnonzero(~hit.any(axis=1))
        if not len(open_):
            return out
        # Upwards until a right neighbour holds the target, then down to its first block that does.
        node, level, want = block[open_], np.full(len(open_), -1), target[open_]
        for k, low in enumerate(self.minima):
            right = np.minimum(node + 1, len(low) - 1)
            found = (level < 0) & (node % 2 == 0) & (node + 1 < len(low)) & (low[right] <= want)
            level[found] = k
            node = np.where(found, node + 1, np.where(level < 0, node // 2, node))
        for k in range(len(self.minima) - 2, -1, -1):
            down = level > k
            left = 2 * node
            low = self.minima[k]
            node = np.where(down, np.where(low[np.minimum(left, len(low) - 1)] <= want, left, left + 1), node)
        out[open_] = node * BLOCK + (self.blocks[node] <= want[:, None]).argmax(axis=1)
        return out


def encode(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(opens, position of each node's open parenthesis) of a forest in depth-first order; a top has parent -1."""
    n = len(parent)
    order = np.argsort(parent, kind="stable")
    starts = np.searchsorted(parent[order], np.arange(-1, n + 1)).tolist()
    children = order.tolist()
    opens, place, at = np.zeros(2 * n, bool), np.empty(n, np.int64), 0
    stack = children[starts[0] : starts[1]][::-1]
    while stack:
        v = stack.pop()
        if v >= 0:
            opens[at], place[v] = True, at
            stack.append(~v)
            stack += children[starts[v + 1] : starts[v + 2]][::-1]
        at += 1
    return opens, place


def subtree_figures(parent: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and savings of each node's subtree; ``leaves`` is what a childless node stands for, ``saved`` each node's own savings."""
    opens, place = encode(parent)
    close = Parentheses(opens).find_close(place)
    pair = opens.copy()
    pair[:-1] &= ~opens[1:]
    rank = np.concatenate([[0], np.cumsum(pair)])  # leaf pairs before a position
    by_place = np.argsort(place)
    pairs = by_place[pair[place[by_place]]]  # the nodes of the leaf pairs, in order
    leaf_sum = np.concatenate([[0], np.cumsum(leaves[pairs])])
    value = np.zeros(len(opens) + 1, np.int64)
    value[place + 1] = saved
    value = np.cumsum(value)  # savings before a position
    return leaf_sum[rank[close]] - leaf_sum[rank[place]], value[close] - value[place]


SHAPE = ["depth", "p", "q", "up_p", "up_q", "conv_id", "up_conv", "up_class", "n_convs", "name", "top", "own", "leaves", "saved", "children"]
MERGED = ("depth long, p long, q long, up_p long, up_q long, conv_id long, up_conv long, up_class int, n_convs long, "
          "n_children long, n_leaves long, saved_tokens long, top boolean")


def _merge_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's nodes and stubs -> its nodes with figures. A stub (own = False) hangs from the node of its identity."""
    own, top = pdf["own"].to_numpy(bool), pdf["top"].to_numpy(bool)
    name = list(zip(pdf["p"].tolist(), pdf["q"].tolist(), pdf["depth"].tolist(), strict=True))
    above = zip(pdf["up_p"].tolist(), pdf["up_q"].tolist(), (pdf["depth"] - 1).tolist(), strict=True)
    index = {k: i for i, k in enumerate(name) if own[i]}
    parent = np.array([-1 if t else index[up if o else at] for at, up, o, t in zip(name, above, own, top, strict=True)], np.int64)
    leaves, saved = subtree_figures(parent, pdf["leaves"].to_numpy(np.int64), pdf["saved"].to_numpy(np.int64))
    below, hung = np.zeros(len(pdf), np.int64), parent >= 0
    np.add.at(below, parent[hung], pdf["children"].to_numpy(np.int64)[hung])
    out = pdf[["depth", "p", "q", "up_p", "up_q", "conv_id", "up_conv", "up_class", "n_convs"]].copy()
    out["n_children"], out["n_leaves"], out["saved_tokens"], out["top"] = below, leaves, saved, top
    return out[own]


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p, q, up_p, up_q, bytes, turns) of every prefix of every conversation, the empty one included.

    ``turns(conv_id, nth, a, b, bytes, turns)``: place in the conversation from 1 on, two hashes of (place, role, text),
    bytes of the text, turns of the whole conversation; one without turns has one row of null nth. A long conversation is
    cut into blocks, whose totals carry the prefix on.
    """
    rows = turns.filter("nth IS NOT NULL").withColumn("part", ordered.rank_block(F.col("nth")))
    inside = Window.partitionBy("conv_id", "part").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.filter(F.col("turns") >= ordered.BLOCK_ROWS).groupBy("conv_id", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carry = totals.select("conv_id", "part", F.bit_xor("a").over(before).alias("ca"), F.bit_xor("b").over(before).alias("cb"))
    rows = rows.withColumns({"p": F.bit_xor("a").over(inside), "q": F.bit_xor("b").over(inside)}).join(carry, ["conv_id", "part"], "left")
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"p": F.col("p").bitwiseXOR(F.coalesce("ca", zero)), "q": F.col("q").bitwiseXOR(F.coalesce("cb", zero))})
    rows = rows.select("conv_id", F.col("nth").alias("depth"), "p", "q", F.col("p").bitwiseXOR(F.col("a")).alias("up_p"),
                       F.col("q").bitwiseXOR(F.col("b")).alias("up_q"), "bytes", "turns")
    start = turns.groupBy("conv_id").agg(F.max("turns").alias("turns"))
    return rows.unionByName(start.select("conv_id", *[zero.alias(c) for c in ("depth", "p", "q", "up_p", "up_q", "bytes")], "turns"))


def members_hash(ends: DataFrame) -> DataFrame:
    """(depth, p, q, ends_sha256): hash of the ascending, comma-joined conv_ids that end at each node.

    Ids are joined in blocks of ID_BLOCK numbers first; the hash then runs over the blocks in order, without gathering them.
    """
    part = ends.groupBy("depth", "p", "q", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    part = part.repartition("depth", "p", "q").sortWithinPartitions("depth", "p", "q", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hashed = None, None
        for b in batches:
            done = []
            for d, p, q, ids in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if (d, p, q) == last:
                    hashed.update(b",")
                else:
                    if last is not None:
                        done.append((*last, hashed.hexdigest()))
                    last, hashed = (d, p, q), hashlib.sha256()
                hashed.update(ids.encode())
            if done:
                yield _rows(done)
        if last is not None:
            yield _rows([(*last, hashed.hexdigest())])

    return part.select("depth", "p", "q", "ids").mapInArrow(run, "depth long, p long, q long, ends_sha256 string")


def _rows(done: list) -> pa.RecordBatch:
    d, p, q, h = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (d, p, q)), pa.array(h, pa.string())], ["depth", "p", "q", "ends_sha256"])


def trie(turns: DataFrame, limit: int = LIMIT, fan: int = FAN) -> DataFrame:
    """One row per node of the prefix trie of ``turns`` (see :func:`paths`): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    steps = cut_lineage(paths(turns), "paths")
    key = ["depth", "p", "q"]
    # A node of weight up to limit is of class 0, up to limit * fan of class 1, and so on.
    level = F.when(F.col("weight") <= limit, 0).otherwise(F.ceil(F.log(F.col("weight") / limit) / math.log(fan) - 1e-9)).cast("int")
    nodes = steps.groupBy(*key).agg(
        F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.sum("turns").alias("weight"),
        *[F.first(c).alias(c) for c in ("up_p", "up_q", "bytes")]).withColumn("class", level).drop("weight")
    nodes = cut_lineage(nodes, "nodes")
    # The highest node of each class on a path names the subtree; a path's own conversation is the smallest through the node.
    steep = steps.join(nodes.select(*key, "class"), key).groupBy("conv_id", "class").agg(F.min(F.struct("depth", "p", "q")).alias("head"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("least").alias("up_conv"), F.col("class").alias("up_class"))
    rows = nodes.join(above, ["depth", "up_p", "up_q"], "left").withColumnRenamed("least", "conv_id").join(steep, ["conv_id", "class"])
    rows = cut_lineage(rows.select(
        *key, "up_p", "up_q", "conv_id", F.coalesce("up_conv", F.lit(0)).alias("up_conv"), F.coalesce("up_class", F.lit(-1)).alias("up_class"), "n_convs", "class",
        (F.struct(*key) == F.col("head")).alias("top"), F.xxhash64("head").alias("name"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "forest")
    sizes = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    done, tops = None, None
    for nth in sorted(sizes):
        own = rows.filter(F.col("class") == nth).withColumns({"own": F.lit(True), "leaves": one, "children": one}).select(*SHAPE)
        if tops is not None:  # what hangs from this class's nodes, summed per node
            stubs = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(
                F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("children")).join(own.select(*key, "name"), key)
            stubs = stubs.withColumns({c: zero for c in ("up_p", "up_q", "conv_id", "up_conv", "n_convs")}).withColumns(
                {"up_class": F.lit(-1), "top": F.lit(False), "own": F.lit(False)})
            own = own.unionByName(stubs.select(*SHAPE))
        shards = max(1, -(-sizes[nth] // limit))
        merged = cut_lineage(own.groupBy(F.pmod("name", F.lit(shards)).alias("shard")).applyInPandas(_merge_shard, MERGED), "merged")
        done = merged if done is None else done.unionByName(merged)
        # A top may hang from a class above the next one: those still open go along.
        hung = merged.filter("top AND depth > 0")
        tops = hung if tops is None else tops.filter(F.col("up_class") > nth).unionByName(hung)
    if done is None:
        done = rows.sparkSession.createDataFrame([], MERGED)
    ends = members_hash(steps.filter(F.col("depth") == F.col("turns")).select(*key, "conv_id"))
    return done.join(ends, key, "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("up_conv")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def numbered(talks: DataFrame) -> DataFrame:
    """(conv_id, nth, a, b, bytes) of all turns, numbered from 1 in each conversation; a and b are hashes of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = cut_lineage(talks.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("bytes")), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    block = F.coalesce(ordered.rank_block(F.col("turn")), F.lit(-(1 << 62)))
    return ordered.dense_index(rows, ["conv_id"], order, "nth", block).select("conv_id", (F.col("nth") + 1).alias("nth"), "a", "b", "bytes")


def placed(turns: DataFrame) -> DataFrame:
    """``turns`` with the position mixed into their hashes."""
    mixed = {x: F.when(F.col("nth").isNotNull(), F.xxhash64(F.lit(k), "nth", x)) for k, x in ((3, "a"), (4, "b"))}
    return turns.withColumns(mixed)


def conversations(talks: DataFrame) -> DataFrame:
    """The turns of ``talks(conv_id, turn, role, text)`` as :func:`trie` takes them."""
    turns = cut_lineage(numbered(talks), "turns")
    return placed(turns.join(turns.groupBy("conv_id").agg(F.max("nth").alias("turns")), "conv_id"))


def rebuilt(talks: DataFrame, heads: int = 9, group: int = 5) -> DataFrame:
    """As :func:`conversations`, with every conversation c rebuilt: the first h turns of conversation c - c % group, then c's
    own behind its first h; h is the CRC of c modulo ``heads``. One left without turns keeps a row of null nth."""
    turns = cut_lineage(numbered(talks), "turns")
    convs = turns.groupBy("conv_id").agg(F.max("nth").alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    names = ["conv_id", "nth", "a", "b", "bytes", "turns"]
    # Each of the first turns goes to the few conversations of its group.
    first = turns.filter(F.col("nth") < heads).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "taken", "turns"), "base").filter("nth <= taken")
    own = turns.join(convs.select("conv_id", "h", "taken", "turns"), "conv_id").filter("nth > h").withColumn("nth", F.col("nth") - F.col("h") + F.col("taken"))
    bare = convs.filter("turns = 0").select("conv_id", *[F.lit(None).cast("long").alias(c) for c in ("nth", "a", "b", "bytes")], "turns")
    return placed(first.select(*names).unionByName(own.select(*names)).unionByName(bare))


# CRC-32 in SQL: every byte of the decimal id is followed by eight shifts (256 stands for one).
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
      lambda a, e: CASE WHEN e = 256 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, e) END))"""
SQL = f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC} % 9 AS h, max(nth) AS n FROM own GROUP BY conv_id),
sized AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
turns AS (
  SELECT s.conv_id, o.nth, o.role, o.text FROM sized s JOIN own o ON o.conv_id = s.base AND o.nth <= s.taken
  UNION ALL SELECT conv_id, o.nth - h + taken, o.role, o.text FROM sized JOIN own o USING (conv_id) WHERE o.nth > h),
steps AS (
  SELECT conv_id, nth AS depth, md5(string_agg(md5(length(role) || role || text), '') OVER (PARTITION BY conv_id ORDER BY nth)) AS id, strlen(text) AS bytes FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM sized),
along AS (SELECT *, lag(id) OVER w AS up, lead(id) OVER w IS NULL AS last FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT depth, id, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, max(bytes) AS bytes,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM along GROUP BY depth, id),
children AS (SELECT depth - 1 AS depth, up AS id, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (depth, id)),
below AS (
  SELECT s.depth, s.id, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved_tokens
  FROM whole v JOIN steps s ON s.conv_id = v.conv_id AND s.depth <= v.depth GROUP BY s.depth, s.id)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM whole v JOIN below b USING (depth, id) LEFT JOIN nodes u ON u.depth = v.depth - 1 AND u.id = v.up
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))
