"""The trie of conversations' turn sequences: members, leaves and shared text of every prefix.

1. A conversation is rebuilt from the first turns of the one that opens its hundred and its own later turns. Its key is the
   concatenation of its turns' digests, so the order of keys is the order of a depth-first walk; equal keys are one row.
2. Keys are sorted into ranges, the shards. A shard writes its trie as balanced parentheses, with the least excess of blocks
   of them in a tree. Find-close over these delimits every subtree; the rank of ``()`` counts its leaves; differences of
   cumulative arrays give its members and savings, and a sparse table the smallest member.
3. Prefixes of a shard's first and last key, its spines, may go on in other shards. They are handed on with what hangs on
   them alone, and groups of neighbouring shards merge their spines the same way, until one group holds what is left.
4. Ids of the conversations that end at one node are sorted in ranges and joined to blocks of text, whose hash is taken in order.

Defined results: turns are ordered by number, null first, then by their digest; repeated turns are turns each. A null role or
text is empty. Rows without a conv_id are in no conversation. An empty table has no nodes. Turns are told apart by 128-bit
digests. A conversation's digests and lengths (not its texts) are one row of one task. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.tables import bounded_batches, materialize

DIGEST = 16  # bytes of a turn's digest
SHARD_TURNS = 100_000
MERGED = 256  # neighbouring shards whose spines are merged at once
BLOCK = 64  # parentheses of a block
ID_TEXT = 1 << 16  # characters of ids joined to one block
NOBODY = np.iinfo(np.int64).max


class Parentheses:
    """A trie as balanced parentheses, from its nodes' depths in the order of a depth-first walk."""

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.open = 2 * np.arange(n) - depth  # before a node, all earlier nodes but its ancestors are closed
        self.bits = np.zeros(2 * n, np.int8)
        self.bits[self.open] = 1
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        pairs = np.zeros(2 * n, bool)
        pairs[:-1] = (self.bits[:-1] == 1) & (self.bits[1:] == 0)
        self.pairs = np.concatenate(([0], np.cumsum(pairs)))
        # least excess of blocks, of two blocks, and so on
        blocks = 1 << max(0, math.ceil(2 * n / BLOCK) - 1).bit_length()
        padded = np.full(blocks * BLOCK, NOBODY)
        padded[: 2 * n] = self.excess
        self.padded = padded
        self.least = [padded.reshape(blocks, BLOCK).min(axis=1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(axis=1))

    def in_block(self, start: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The first place from ``start`` on, within its block, whose excess is not above what is wanted, or -1."""
        found = np.full(len(start), -1)
        open_, at = np.arange(len(start)), start.copy()
        while len(open_):
            hit = self.padded[at] <= wanted[open_]
            found[open_[hit]] = at[hit]
            at = at + 1
            on = ~hit & (at % BLOCK != 0)
            open_, at = open_[on], at[on]
        return found

    def find_close(self) -> np.ndarray:
        """The closing parenthesis of every node."""
        wanted = self.excess[self.open] - 1
        found = np.full(len(self.open), -1)
        inside = np.flatnonzero((self.open + 1) % BLOCK != 0)
        found[inside] = self.in_block(self.open[inside] + 1, wanted[inside])
        left = np.flatnonzero(found < 0)
        # the blocks from ``block`` on are open: up until one has an excess that low, then down into its leftmost such half
        block, want, level = self.open[left] // BLOCK + 1, wanted[left], np.zeros(len(left), np.int64)
        climbing = np.arange(len(left))
        for k, least in enumerate(self.least):
            at = block[climbing]
            hit = ((at % 2 == 1) | (len(least) == 1)) & (least[np.minimum(at, len(least) - 1)] <= want[climbing])
            level[climbing[hit]] = k
            climbing = climbing[~hit]
            block[climbing] = (block[climbing] + 1) // 2
        for k in range(len(self.least) - 1, 0, -1):
            mine = np.flatnonzero(level == k)
            block[mine] *= 2
            block[mine] += self.least[k - 1][block[mine]] > want[mine]
            level[mine] = k - 1
        found[left] = self.in_block(block * BLOCK, want)
        return found

    def leaves(self, close: np.ndarray) -> np.ndarray:
        """Pairs ``()`` within every node's parentheses."""
        return self.pairs[close] - self.pairs[self.open]


def range_min(values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The least of ``values[a:z]`` for ranges that are not empty."""
    table, width = [values], 1
    while 2 * width <= len(values):
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    level = np.frexp((z - a).astype(float))[1] - 1
    out = np.empty(len(a), np.int64)
    for k in np.unique(level):
        mine = level == k
        out[mine] = np.minimum(table[k][a[mine]], table[k][z[mine] - (1 << int(k))])
    return out


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two keys have in common at their start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (differ.bit_length() + 7) // 8) // DIGEST


def digests(key: bytes) -> list[str]:
    """The name of every prefix of a key, from that without turns on."""
    whole, out = hashlib.md5(), []
    out.append(whole.hexdigest())
    for k in range(0, len(key), DIGEST):
        whole.update(key[k : k + DIGEST])
        out.append(whole.hexdigest())
    return out


FIELDS = ("members", "least", "saved", "leaves", "children", "ends", "first_end")
SMALLEST = ("least", "first_end")  # added up by the smaller one


def merge(paths: list[tuple[bytes, np.ndarray, dict[str, np.ndarray]]], whole: bool) -> tuple[pa.Table, list]:
    """The nodes of the trie of paths (key, lengths of turns, what the last nodes on the path add), and its spines as paths.

    Without ``whole``, prefixes of the first and last key are not among the nodes: they come back as paths, with what they
    have by themselves and by the subtrees that hang on them.
    """
    paths.sort(key=lambda p: p[0])
    depth, length, names, rows = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], digests(b""), []
    place, n, before = np.zeros(1, np.int64), 1, b""
    for key, lens, _ in paths:
        turns, same = len(key) // DIGEST, shared_turns(before, key)
        depth.append(np.arange(same + 1, turns + 1))
        length.append(lens[same:])
        names += digests(key)[same + 1 :]
        place = np.concatenate((place[: same + 1], n + np.arange(turns - same)))
        rows.append(place)
        n, before = n + turns - same, key
    depth, length, names = np.concatenate(depth), np.concatenate(length), np.array(names)
    own = {f: np.full(n, NOBODY) if f in SMALLEST else np.zeros(n, np.int64) for f in FIELDS}
    for place, (_, _, added) in zip(rows, paths, strict=True):
        for f, values in added.items():
            at = place[len(place) - len(values) :]
            own[f][at] = np.minimum(own[f][at], values) if f in SMALLEST else own[f][at] + values

    trie = Parentheses(depth)
    close = trie.find_close()
    size = (close - trie.open + 1) // 2
    first, end = np.arange(n), np.arange(n) + size

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[end] - sums[first]

    # the parent is the last node before that is one level up
    by_depth = np.lexsort((first, depth))
    parent = by_depth[np.searchsorted((depth * n + first)[by_depth], (depth - 1) * n + first) - 1]
    parent[0] = -1
    spine = np.zeros(n, bool)
    ends = [] if whole else [0, len(paths) - 1]
    for k in ends:
        spine[rows[k]] = True
    members, least = total(own["members"]), range_min(own["least"], first, end)
    children = own["children"] + np.bincount(parent[1:], minlength=n)
    # a pair () is a leaf, unless it has children that were complete before
    leaves = trie.leaves(close) - total((size == 1) & (own["children"] > 0)) + total(own["leaves"])
    saved = total(np.where(spine, 0, (members - 1) * length) + own["saved"])

    done = np.flatnonzero(~spine)
    above = parent[done]
    known = (above >= 0) & ~spine[above]
    nobody = np.full(len(done), None)
    nodes = pa.table({
        "node": pa.array(names[done], pa.string()), "parent": pa.array(np.where((above >= 0) & ~known, names[above], nobody), pa.string()), "conv_id": least[done],
        "parent_conv_id": pa.array(least[above], pa.int64(), mask=~known), "depth": depth[done], "n_convs": members[done], "n_children": children[done],
        "n_leaves": leaves[done], "saved_tokens": saved[done], "n_ends": own["ends"][done], "first_end_id": pa.array(own["first_end"][done], pa.int64(), mask=own["ends"][done] == 0)})
    if whole:
        return nodes, []
    hung = {f: v.copy() for f, v in own.items()}
    mine = done[spine[above]]
    for f, values in (("members", members), ("saved", saved), ("leaves", leaves), ("children", np.ones(n, np.int64))):
        np.add.at(hung[f], parent[mine], values[mine])
    np.minimum.at(hung["least"], parent[mine], least[mine])
    out = []
    for k in dict.fromkeys(ends):
        out.append((paths[k][0], paths[k][1], {f: v[rows[k]] for f, v in hung.items()}))
        for f, v in hung.items():  # nodes of both spines are told once
            v[rows[k]] = NOBODY if f in SMALLEST else 0
    return nodes, out


def told(nodes: pa.Table, spines: list, shard: int) -> Iterator[pa.RecordBatch]:
    """Nodes and spines as rows of one table."""
    names = [f.name for f in ROWS]
    columns = [nodes.column(c).combine_chunks() if c in nodes.column_names else pa.nulls(nodes.num_rows, ROWS.field(c).type) for c in names]
    yield pa.RecordBatch.from_arrays(columns, schema=ROWS)
    for key, lens, added in spines:
        row = {"shard": shard, "key": key, "lens": lens} | added
        yield pa.RecordBatch.from_arrays([pa.array([row.get(c)], ROWS.field(c).type) for c in names], schema=ROWS)


ROWS = pa.schema(
    [("node", pa.string()), ("parent", pa.string())] + [(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")]
    + [("first_end_id", pa.int64()), ("shard", pa.int32()), ("key", pa.binary()), ("lens", pa.list_(pa.int64()))] + [(f, pa.list_(pa.int64())) for f in FIELDS])


def shard_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie of a range of keys (key, lens, n, least)."""
    paths = []
    for batch in batches:
        keys, counts, least = batch.column(0).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for k, key in enumerate(keys):
            count, one = counts[k : k + 1], least[k : k + 1]
            paths.append((key, batch.column(1)[k].values.to_numpy(), {"members": count, "least": one, "ends": count, "first_end": one}))
    if paths:
        yield from told(*merge(paths, False), TaskContext.get().partitionId())


def merge_spines(whole: bool):
    def run(shard: tuple, rows: pa.Table) -> pa.Table:
        paths = []
        for batch in rows.to_batches():
            for k in range(batch.num_rows):
                value = lambda c: batch.column(batch.schema.get_field_index(c))[k]  # noqa: B023, E731
                paths.append((value("key").as_py(), value("lens").values.to_numpy(), {f: value(f).values.to_numpy() for f in FIELDS}))
        return pa.Table.from_batches(told(*merge(paths, whole), shard[0].as_py()), schema=ROWS)

    return run


def rebuilt(conversations: DataFrame, hundred: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, node, key, lens) of every conversation, after its first turns came from the one that opens its hundred."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("chars"))
    own = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    openers = own.where(F.col("conv_id") % hundred == 0).select(F.col("conv_id").alias("opener"), F.slice("turns", 1, most - 1).alias("opening"))
    both = own.withColumn("opener", F.col("conv_id") - F.col("conv_id") % hundred).join(openers, "opener", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    turns = F.concat(F.coalesce(F.slice("opening", F.lit(1), h), F.slice("turns", 1, 0)), F.slice("turns", h + 1, F.size("turns")))
    both = both.select("conv_id", turns.alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    return both.select("conv_id", key.alias("key"), F.md5(key).alias("node"), F.transform("turns", lambda t: t.chars).alias("lens"))


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the ids (node, conv_id) that end at a node, in order, with commas between them."""

    def join_ids_of_range(batches):
        held, node, size = [], None, 0
        for batch in batches:
            for name, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (name != node or size > ID_TEXT):
                    yield pa.record_batch([[node], [held[0]], [",".join(map(str, held))]], names=["node", "first", "ids"])
                    held, size = [], 0
                node, size = name, size + len(str(i)) + 1
                held.append(i)
        if held:
            yield pa.record_batch([[node], [held[0]], [",".join(map(str, held))]], names=["node", "first", "ids"])

    def hash_blocks(batches):
        node, whole = None, None
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != node:
                    if node is not None:
                        yield pa.record_batch([[node], [whole.hexdigest()]], names=["node", "ends_sha256"])
                    node, whole = name, hashlib.sha256(ids.encode())
                else:
                    whole.update(("," + ids).encode())
        if node is not None:
            yield pa.record_batch([[node], [whole.hexdigest()]], names=["node", "ends_sha256"])

    ordered = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    blocks = ordered.mapInArrow(join_ids_of_range, "node string, first long, ids string")
    return blocks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hash_blocks, "node string, ends_sha256 string")


def trie_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS, merged: int = MERGED) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    rows_schema = ("node string, parent string, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, n_ends long, "
                   "first_end_id long, shard int, key binary, lens array<long>, " + ", ".join(f"{f} array<long>" for f in FIELDS))
    convs = materialize(rebuilt(bounded_batches(conversations)))
    keys = materialize(convs.groupBy("key", "lens", "node").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")))
    shards = math.ceil((keys.agg(F.sum(F.size("lens") + 1)).first()[0] or 1) / shard_turns)
    step = materialize(keys.select("key", "lens", "n", "least").repartitionByRange(shards, "key").mapInArrow(shard_tries, rows_schema))
    levels = [step.where("node is not null")]
    while True:
        spines = step.where("node is null")
        last = spines.agg(F.max("shard")).first()[0]
        if last is None:
            break
        groups = spines.withColumn("shard", (F.col("shard") / merged).cast("int")).groupBy("shard")
        step = materialize(groups.applyInArrow(merge_spines(last < merged), rows_schema))
        levels.append(step.where("node is not null"))
        if last < merged:
            break
    nodes, heads = levels[0], None
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
        some = level.select(F.col("node").alias("parent"), F.col("conv_id").alias("found"))
        heads = some if heads is None else heads.union(some)
    if heads is not None:  # parents on a spine
        waiting = nodes.where("parent is not null").join(heads, "parent").withColumn("parent_conv_id", F.col("found")).select(nodes.columns)
        nodes = nodes.where("parent is null").unionByName(waiting)
    several = keys.where("n > 1").select("node")
    hashes = ends_hashes(convs.select("node", "conv_id").join(several, "node", "left_semi"))
    one = nodes.where("n_ends < 2").withColumn("ends_sha256", F.sha2(F.coalesce(F.col("first_end_id").cast("string"), F.lit("")), 256))
    many = nodes.where("n_ends > 1").join(hashes, "node")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return one.select(columns).unionByName(many.select(columns))


def oracle(table: str = "conversations", hundred: int = 100, most: int = 6) -> str:
    """The same rows in DuckDB SQL."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    crc = f"xor(list_reduce(list_transform(range(len(conv_id::VARCHAR)), lambda k: ascii(substr(conv_id::VARCHAR, k + 1, 1))::BIGINT), lambda c, b: list_reduce(range(8), lambda x, i: {step}, xor(c, b)), 4294967295), 4294967295)"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table} WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, md5(strlen(role) || ':' || role || text) AS digest, length(text) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS i FROM t
), c AS (
  SELECT conv_id, {crc} % {most} AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, o.i, o.digest, o.chars FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {hundred} WHERE o.i <= h
  UNION ALL SELECT c.conv_id, o.i + {most}, o.digest, o.chars FROM c JOIN o USING (conv_id) WHERE o.i > h
), s AS (
  SELECT conv_id, digest, chars, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth FROM r
), p AS (
  SELECT conv_id, depth, chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1 AS ends FROM p
), n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM w GROUP BY node, depth
), k AS (
  SELECT left(node, 32 * (depth - 1)) AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)
), u AS (
  SELECT left(node, 32 * up) AS node, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM m) GROUP BY 1
)
SELECT m.conv_id, m.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (node) LEFT JOIN n q ON m.depth > 0 AND q.node = left(m.node, 32 * (m.depth - 1))
"""
