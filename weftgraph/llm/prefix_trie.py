"""Conversation prefix trie, rolled up by pointer jumping.

Conversations are first rebuilt so that they share openings: each takes the first h turns of the first
conversation of its group of GROUP ids, then its own turns after its first h; h is the CRC-32 of its id
modulo HEADS. A node of the trie is a distinct sequence of first turns, keyed by a digest of its whole path:

1. Turns are numbered after a sort dealt by ranges of (conv_id, turn, role): a conversation of any length
   spans tasks, and only counts of its parts are summed. Texts go no further: a turn is then a digest and a
   number of words.
2. Digests are chained inside blocks of BLOCK turns, and blocks are prefixed by doubling: a block's digest
   joins that of as many blocks before it, twice as many in each round. Conversations of up to BLOCK turns
   need no round. A path's digest depends on its turns and its depth only.
3. Members of a node meet by its key, counted in each task first. Each node has one edge, to the key of
   the path without its last turn.
4. Pointer jumping: every node holds sums over what lies less than 2**k levels below it and the key of its
   ancestor 2**k levels above. In a round it gives its sums to that ancestor, then takes that ancestor's
   pointer: a chain of n turns takes log2(n) rounds, each one aggregation and one join.
5. The ids of conversations that end at a node are dealt by ranges of (node, id), joined to strings of PIECE
   ids, and these are hashed in order, streaming: no task holds a node's list.

Defined results: a null role or text is empty; turns are ordered by turn (null first), then role, then text,
so repeated rows are turns each; rows with a null conv_id belong to no conversation and are left out; the
group of a negative id is that of the remainder with the id's sign; a conversation that has no turn left
ends at the root; a text of any length is one row; other columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

GROUP, HEADS = 20, 4
BLOCK = 64
PIECE = 8192
ROOT_KEY = bytes(32)


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn_key, words): places ascend within a conversation and tell the task, as monotonic ids do."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    key = _sha(F.length("role").cast("string").cast("binary"), F.lit(b":"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    return stored(dealt.select("conv_id", F.monotonically_increasing_id().alias("place"), key.alias("turn_key"), words.alias("words")), "trie-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, pos, length, turn_key, words), and all conversations (conv_id, length)."""
    rows = turn_digests(turns).withColumn("part", F.shiftright("place", 33))
    parts = stored(rows.groupBy("conv_id", "part").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n")), "trie-parts")
    own = parts.groupBy("conv_id").agg(F.sum("n").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = own.select("conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    convs = convs.join(own.toDF("base", "n_base"), "base", "left").withColumn("heads", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(convs.withColumn("length", F.col("heads") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "trie-conversations")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("conv_id", "part", "least", before.alias("before")).join(convs.select("conv_id", "h", "heads", "length"), "conv_id")
    numbered = rows.join(starts, ["conv_id", "part"]).withColumn("ord", F.col("before") + F.col("place") - F.col("least") + 1)
    tails = numbered.where("ord > h").select("conv_id", (F.col("heads") + F.col("ord") - F.col("h")).alias("pos"), "length", "turn_key", "words")
    shared = numbered.where((F.col("conv_id") % GROUP == 0) & (F.col("ord") < HEADS)).select(F.col("conv_id").alias("base"), "ord", "turn_key", "words")
    heads = convs.where("heads > 0").select("conv_id", "base", "heads", "length").join(shared, "base").where("ord <= heads")
    return tails.union(heads.select("conv_id", F.col("ord").alias("pos"), "length", "turn_key", "words")), convs.select("conv_id", "length")


def _carried(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, carry): a digest of all blocks up to this one, of conversations that have several."""
    state = stored(blocks.where(F.col("length") > BLOCK).select("conv_id", "block", F.element_at("chain", -1).alias("carry")), "trie-blocks")
    last, step = state.agg(F.max("block")).first()[0] or 0, 1
    while step <= last:
        left = state.select("conv_id", (F.col("block") + step).alias("block"), F.col("carry").alias("left"))
        state = state.join(left, ["conv_id", "block"], "left").select("conv_id", "block", F.when(F.col("left").isNull(), F.col("carry")).otherwise(_sha("left", "carry")).alias("carry"))
        state, step = stored(state, "trie-blocks"), step * 2
    return state


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, words, ends): for each turn the node it reaches and the node it comes from."""
    block = F.floor((F.col("pos") - 1) / BLOCK)
    grouped = turns.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_key", "words"))).alias("items"), F.max("length").alias("length"))
    chain = F.aggregate("items", F.array().cast("array<binary>"), lambda done, x: F.concat(done, F.array(_sha(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(b"")), x.turn_key))))
    blocks = stored(grouped.withColumn("chain", chain), "trie-chains")
    carried = _carried(blocks)
    tails = blocks.where(F.col("length") > BLOCK).select("conv_id", "block", F.element_at("chain", -1).alias("tail")).join(carried, ["conv_id", "block"])
    # what lies before a block, and before the block before it
    prior = tails.select("conv_id", (F.col("block") + 1).alias("block"), "carry", "tail")
    before = carried.select("conv_id", (F.col("block") + 2).alias("block"), F.col("carry").alias("carry2"))
    prior = prior.join(before, ["conv_id", "block"], "left")
    far = blocks.where("block > 0").join(prior, ["conv_id", "block"])
    near = blocks.where("block = 0").withColumns({c: F.lit(None).cast("binary") for c in ("carry", "tail", "carry2")})

    def key(depth: Column, carry: Column, inner: Column) -> Column:
        return _sha(depth.cast("string").cast("binary"), F.lit(b":"), F.coalesce(carry, F.lit(b"")), inner)

    first = F.col("block") * BLOCK
    whole = near.unionByName(far).withColumn("keys", F.transform("chain", lambda x, i: key(first + i + 1, F.col("carry"), x)))
    entry = F.when(F.col("block") == 0, F.lit(ROOT_KEY)).otherwise(key(first, F.col("carry2"), F.col("tail")))
    parents = F.concat(F.array(entry), F.slice("keys", 1, F.size("keys") - 1))
    rows = whole.select("conv_id", "length", F.explode(F.arrays_zip("items", "keys", parents.alias("parents"))).alias("e"))
    return rows.select("conv_id", F.col("e.items.pos").alias("depth"), F.col("e.keys").alias("key"), F.col("e.parents").alias("parent"), F.col("e.items.words").alias("words"), (F.col("e.items.pos") == F.col("length")).alias("ends"))


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(key, *sums), each summed over the node and all below it, of nodes (key, parent, depth, *sums)."""
    deepest, step = nodes.agg(F.max("depth")).first()[0] or 0, 1
    state = nodes.select("key", F.col("parent").alias("up"), *sums)
    while step <= deepest:
        given = state.where("up is not null").select(F.col("up").alias("key"), *sums)
        total = state.select("key", *sums).union(given).groupBy("key").agg(*[F.sum(c).alias(c) for c in sums])
        jump = state.where("up is not null").select("key", "up").join(state.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("next")), "up")
        state, step = stored(total.join(jump.select("key", F.col("next").alias("up")), "key", "left").select("key", "up", *sums), "trie-sums"), step * 2
    return state.select("key", *sums)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, PIECE at most a row."""
    key, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "least", "ids"])

    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and (k != key or len(ids) == PIECE):
                yield row()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = sha = None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if k != key:
                if sha is not None:
                    yield row()
                key, sha = k, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if sha is not None:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of ends (key, conv_id)."""
    dealt = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = dealt.mapInArrow(_pieces, "key binary, least long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "least").mapInArrow(_hashed, "key binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(turns)
    steps = stored(prefixes(rows), "trie-steps")
    n = F.count(F.lit(1))
    nodes = steps.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), n.alias("n_convs"), F.max("words").alias("words"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), n.alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT_KEY).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = stored(nodes.union(root), "trie-nodes")
    below = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(n.alias("n_children"))
    nodes = nodes.join(below, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stored(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "trie-nodes")
    sums = rolled_up(nodes, ["n_leaves", "saved_tokens"])
    ended = end_digests(steps.where("ends").select("key", "conv_id").union(convs.where("length = 0").select(F.lit(ROOT_KEY), "conv_id")))
    over = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, "key").join(ended, "key", "left").join(over, "parent", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP12_SQL = rf"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY c),
h AS (SELECT c, l, c - c % {GROUP} AS base,
  (xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda crc, b:
    list_reduce(list_transform(range(8), lambda i: i::BIGINT), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, b)), 4294967295::BIGINT), 4294967295) % {HEADS})::BIGINT AS h FROM own),
p AS (SELECT h.c, coalesce(b.l[1:h.h], []) || h.l[h.h + 1:] AS p FROM h LEFT JOIN own b ON b.c = h.base),
m AS (SELECT c, k AS depth, p[1:k] AS path, k = len(p) AS ends FROM p, unnest(range(0, len(p) + 1)) AS u(k)),
n AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended,
  coalesce(len(regexp_extract_all(path[depth].t, '{WORD}')), 0) AS words FROM m GROUP BY 1, 2),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids ON kids.depth = n.depth AND kids.path = n.path),
s AS (SELECT path[1:k] AS path, k AS depth, sum((kids = 0)::BIGINT) AS leaves, sum((n_convs - 1) * words) AS saved FROM v, unnest(range(0, depth + 1)) AS u(k) GROUP BY 1, 2)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.kids AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(v.ended) AS ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.path = v.path LEFT JOIN n up ON up.depth = v.depth - 1 AND up.path = v.path[1:v.depth - 1]
"""
