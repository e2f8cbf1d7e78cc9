"""Prefix trie of conversations by chained digests.

A turn's digest is SHA-256 of its role's and its text's. A prefix's digest is chained: that of the prefix before it,
followed by its last turn's. Every conversation gives a row for every prefix; grouped by (depth, digest), they are the
nodes. A conversation of any length is chained in blocks of BLOCK turns: blocks are digested one by one, then the blocks
of a conversation are chained, and each prefix starts from the block it is in, so no task chains a long conversation
turn by turn. Block borders are depths, so that equal prefixes still have equal digests.

Sums over subtrees: a node belongs to its smallest member. A conversation's nodes are the lower end of its path, since a
node's members are also members of all nodes above. Within them sums run upwards in blocks of depth; their total is
exploded to all ancestors that belong to others, one row for each prefix of the conversation. So what is exploded grows
with the turns, not with their square, and a node that many share meets in partial sums.

Order is by turn (null first), equal turns by their digest. A null role or text is an empty one; rows without conv_id
belong to no conversation and are left out. Rows that repeat are turns of their own. Texts of any length are digested
where they are read and never move. No conversations give no nodes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked_within
from .session import Shelf, looked_up

#: Turns of a block, and decimal ids of a piece of a member list.
BLOCK, PIECE = 256, 8192
ROOT = hashlib.sha256(b"").digest()
#: Every SHARE conversations share the first turns of one, of which each takes up to HEAD - 1.
SHARE, HEAD = 5, 9


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), length of the conversation, digest and n_bytes of each turn."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.sha2(part("role"), 256), F.sha2(part("text"), 256)), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(part("text")).cast("bigint").alias("n_bytes"))
    placed = ranked_within(rows, "conv_id", [F.col("turn").asc_nulls_first(), "digest"], size="length")
    return placed.select("conv_id", "place", "length", "digest", "n_bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns with each conversation's first h exchanged for those of the first of its SHARE, h = crc32(conv_id) % HEAD. One without turns left is a row of place 0."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).alias("h")
    convs = turns.filter("place = 1").select("conv_id", F.col("length").alias("own"), h, (F.col("conv_id") - F.col("conv_id") % SHARE).alias("of"))
    given = convs.select(F.col("conv_id").alias("of"), F.col("own").alias("there"))
    plan = convs.join(given, "of", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    plan = plan.select("conv_id", "of", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    heads = turns.filter(F.col("place") < HEAD).select(F.col("conv_id").alias("of"), "place", "digest", "n_bytes")
    heads = plan.join(heads, "of").filter("place <= taken").select("conv_id", "place", "length", "digest", "n_bytes")
    tails = looked_up(turns.drop("length").withColumn("h", h).filter("place > h"), "conv_id", plan.select("conv_id", "taken", "length"), "place")
    tails = tails.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "length", "digest", "n_bytes")
    none = plan.filter("length = 0").select("conv_id", F.lit(0).cast("bigint").alias("place"), "length", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("n_bytes"))
    return heads.union(tails).union(none)


def _head_of_next(head: bytes, block: bytes) -> bytes:
    return hashlib.sha256(head + block).digest()


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block and what the block's chain starts from, of (conv_id, blocks in order)."""
    for batch in batches:
        found = []
        for conv, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            head = ROOT
            for b in blocks:
                found.append((conv, b["block"], head))
                head = _head_of_next(head, b["own"]) if b["own"] else None
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)] if found else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary())], names=["conv_id", "block", "head"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes that end in a block, of (conv_id, length, turns in order, own digest, head)."""
    for batch in batches:
        out = []
        for conv, length, turns, own, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            last = head = head or ROOT
            for t in turns:
                now = _head_of_next(head, own) if t["place"] % BLOCK == 0 else hashlib.sha256(last + t["digest"]).digest()
                out.append((conv, t["place"], now, last, t["n_bytes"], t["place"] == length))
                last = now
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "depth", "digest", "parent", "n_bytes", "ends"])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent (null at the root), n_bytes of the last text, ends (the conversation is no longer) of each prefix, the empty one included."""
    block = F.expr(f"(place - 1) div {BLOCK}").alias("block")
    blocks = turns.filter("place > 0").groupBy("conv_id", "length", block).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "n_bytes"))).alias("turns"))
    own = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""), 256))
    blocks = blocks.withColumn("own", F.when(F.size("turns") == BLOCK, own))
    long = blocks.filter((F.col("length") > BLOCK) & F.col("own").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "own"))).alias("blocks"))
    more = F.struct((F.element_at("blocks", -1)["block"] + 1).alias("block"), F.lit(None).cast("binary").alias("own"))
    heads = long.select("conv_id", F.concat("blocks", F.array(more)).alias("blocks")).mapInArrow(_heads, "conv_id bigint, block bigint, head binary")
    rows = blocks.join(heads, ["conv_id", "block"], "left").select("conv_id", "length", "turns", "own", "head")
    found = rows.mapInArrow(_prefixes, "conv_id bigint, depth bigint, digest binary, parent binary, n_bytes bigint, ends boolean")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("binary")
    roots = turns.filter("place = least(1, length)").select("conv_id", zero.alias("depth"), F.lit(ROOT).alias("digest"), none.alias("parent"), zero.alias("n_bytes"), (F.col("length") == 0).alias("ends"))
    return found.union(roots)


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, first id and decimal ids with commas of stretches of rows sorted by (digest, conv_id)."""
    for batch in batches:
        digests, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        begins = [i for i in range(len(ids)) if i == 0 or digests[i] != digests[i - 1] or i % PIECE == 0]
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(begins, [*begins[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in begins], pa.binary()), pa.array([ids[i] for i in begins], pa.int64()), pa.array(texts, pa.string())], names=["digest", "first", "ids"])


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest and SHA-256 of all its ids, of pieces sorted by (digest, first id): one state is kept, whatever the number of ids."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = digest, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["digest", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends_sha256"])


def member_digests(ends: DataFrame) -> DataFrame:
    """digest, ends_sha256 of rows (digest, conv_id): SHA-256 of the ascending decimal ids with commas. A range sort deals the ids of a frequent node to many tasks as text; one task digests these pieces in order."""
    pieces = ends.select("digest", "conv_id").orderBy("digest", "conv_id").mapInArrow(_id_pieces, "digest binary, first bigint, ids string")
    dealt = pieces.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids")
    return dealt.mapInArrow(_id_digests, "digest binary, ends_sha256 string")


def _sums_from(nodes: DataFrame) -> DataFrame:
    """digest, and leaf and saved summed over the owner's nodes from that depth down: in blocks of depth, so a long path is no one window."""
    dealt = nodes.select("digest", "owner", "depth", "leaf", "saved", F.expr(f"depth div {BLOCK}").alias("block"))
    below = Window.partitionBy("owner").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt.groupBy("owner", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    under = blocks.select("owner", "block", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_under") for c in ("leaf", "saved")))
    within = Window.partitionBy("owner", "block").orderBy(F.desc("depth"))
    return dealt.join(under, ["owner", "block"]).select("digest", *((F.sum(c).over(within) + F.col(f"{c}_under")).alias(f"{c}_own") for c in ("leaf", "saved")))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each node of turns (conv_id, place, length, digest, n_bytes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest."""
    shelf = Shelf(turns.sparkSession)
    rows = shelf.put(prefixes(turns))
    nodes = rows.groupBy("depth", "digest", "parent", "n_bytes").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"))
    nodes = shelf.put(nodes)
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    counted = shelf.put(counted.withColumns({"leaf": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}))
    totals = counted.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.min("depth").alias("top"))
    above = looked_up(rows.select("conv_id", "depth", "digest"), "conv_id", totals, "depth").filter("depth < top")
    others = above.groupBy("digest").agg(F.sum("leaf").alias("leaf_others"), F.sum("saved").alias("saved_others"))
    parents = counted.select(F.col("digest").alias("parent"), F.col("owner").alias("parent_conv_id"))
    named = looked_up(counted, "parent", parents, "digest")
    ends = member_digests(rows.filter("ends"))
    whole = named.join(_sums_from(counted), "digest").join(others, "digest", "left").join(ends, "digest", "left")
    total = lambda c: F.col(f"{c}_own") + F.coalesce(f"{c}_others", F.lit(0))
    return whole.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", total("leaf").cast("bigint").alias("n_leaves"), total("saved").cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "digest",
    )
