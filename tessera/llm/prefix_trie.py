"""A trie of the prefixes that conversations share, and what a cache of them would save.

A turn is a digest of its role and text, a prefix a digest of its turns' digests, so that texts are read once and not
dealt out. Prefixes are counted by partial aggregation: copies of a conversation, however many, are one path. The nodes
are dealt out by a hash of their first turn; a task builds dictionary tries of pointers and sums them in an iterative
postorder. A first turn with too many nodes for a task is taken apart: its node waits, and the subtries of its next turns
are dealt out by themselves, and so on; the nodes that wait are summed from their children's sums at the end. What is too
large still, deep below turns that very many share or along a conversation of very many turns, is summed along the paths of
conversations: a node counts with the smallest of its members, and these nodes are the end of that one's path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, small, written

#: Nodes of a subtrie that one task builds at most; nodes in a task's tries, about; times that subtries are taken apart by their next turn.
MOST, SHELF, ROUNDS = 50_000, 20_000, 12
#: Bytes of ids in a row.
CHUNK = 1 << 16
ROOT = b""
_SUMS = "n_children long, n_leaves long, saved_tokens long"


def digested(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, digest, words for each row with a conversation: null roles and texts are empty ones."""
    conv, turn, role, text = (F.col("`" + c.replace("`", "``") + "`") for c in (conv_col, turn_col, role_col, text_col))
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return conversations.filter(conv.isNotNull()).select(conv.cast("long").alias("conv_id"), turn.alias("turn"), digest.alias("digest"), words.alias("words"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order -> conv_id, depth, path, parent, anchor (the first turn's path), words, ends (whether it is the last turn)."""
    conv, depth, path, anchor, held = None, 0, ROOT, ROOT, None
    names = ["conv_id", "depth", "path", "parent", "anchor", "words", "ends"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]

    def columns(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in small(batches):
        out = []
        for own, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "words")), strict=True):
            if held is not None:
                out.append((*held, own != conv))
            if own != conv:
                conv, depth, path = own, 0, ROOT
            parent, depth = path, depth + 1
            path = hashlib.blake2b(parent + digest, digest_size=16).digest()
            anchor = path if depth == 1 else anchor
            held = (conv, depth, path, parent, anchor, words)
        if out:
            yield columns(out)
    if held is not None:
        yield columns([(*held, True)])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, conv_id) in order -> path, first, ids, sha: ids in chunks for the first and the last path of a task, which may go on in another; else the digest."""
    place, first_path, sha, sent = None, True, None, False
    ids: list[str] = []
    at = size = 0
    out: list[tuple] = []

    def record() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "first", "ids", "sha"])

    # whether a path is a task's last shows only at the end, so chunks of it wait, but for its digest so far
    waiting: list[tuple] = []
    for batch in small(batches):
        for path, conv in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id")), strict=True):
            if path != place:
                if place is not None:
                    waiting.append((place, at, ",".join(ids), None))
                    if first_path:
                        out += waiting
                    else:
                        for chunk in waiting:
                            sha.update((b"," if sent else b"") + chunk[2].encode())
                            sent = True
                        out.append((place, None, None, sha.hexdigest()))
                    first_path = False
                place, waiting, ids, size, at, sha, sent = path, [], [], 0, conv, hashlib.sha256(), False
            if size >= CHUNK:
                waiting.append((place, at, ",".join(ids), None))
                ids, size, at = [], 0, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        if out:
            yield record()
            out.clear()
    if place is not None:
        out += [*waiting, (place, at, ",".join(ids), None)]
        yield record()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids in order -> path, sha: no more than a chunk is held."""
    place, sha = None, None
    for batch in small(batches):
        out = []
        for path, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "ids")), strict=True):
            if path != place:
                if place is not None:
                    out.append((place, sha.hexdigest()))
                place, sha = path, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([s for _, s in out])], names=["path", "sha"])
    if place is not None:
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.binary()), pa.array([sha.hexdigest()])], names=["path", "sha"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """path, sha for rows (path, conv_id): SHA-256 of the ids in ascending order, joined by commas.

    Ids are ordered by range and joined into chunks first, so that the one stream that a digest needs has a row for some
    thousand conversations.
    """
    parts = ends.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_joined, "path binary, first long, ids string, sha string")
    parts = written(parts, "ends")
    split = parts.filter("ids IS NOT NULL").repartition("path").sortWithinPartitions("path", "first").select("path", "ids").mapInArrow(_hashed, "path binary, sha string")
    return parts.filter("sha IS NOT NULL").select("path", "sha").unionByName(split)


def _built(nodes: pd.DataFrame) -> pd.DataFrame:
    """Tries of the nodes of some anchors, summed from their ends."""
    at = {path: k for k, path in enumerate(nodes["path"])}
    parents = [at.get(p, -1) for p in nodes["parent"]]
    children: dict[int, list[int]] = {}
    for k, parent in enumerate(parents):
        children.setdefault(parent, []).append(k)
    saved = ((nodes["n_convs"] - 1) * nodes["words"]).tolist()
    leaves = [0] * len(saved)
    stack = list(children.get(-1, []))
    while stack:  # a node is met twice: before its children, and when all of them are summed
        k = stack.pop()
        if k >= 0:
            stack.append(~k)
            stack += children.get(k, [])
            continue
        k = ~k
        leaves[k] = leaves[k] or 1
        if parents[k] >= 0:
            leaves[parents[k]] += leaves[k]
            saved[parents[k]] += saved[k]
    convs = nodes["conv_id"].tolist()
    above = pd.array([convs[p] if p >= 0 else None for p in parents], "Int64")
    out = nodes[["path", "parent", "conv_id", "depth", "n_convs"]].reset_index(drop=True)
    return out.assign(parent_conv_id=above, n_children=[len(children.get(k, ())) for k in range(len(convs))], n_leaves=leaves, saved_tokens=saved)


def _along(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """The same sums of nodes whose descendants are all there, along conversations' paths."""
    kids = nodes.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "path")
    known = nodes.join(kids, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = written(known, "deep")
    own = known.select("path", F.col("conv_id").alias("owner"), ((F.col("n_convs") - 1) * F.col("words")).alias("cost"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    owners = known.select("conv_id").distinct()
    steps = turns.join(owners, "conv_id", "left_semi").select("conv_id", "depth", "path").join(own, "path")
    mine, below = F.col("owner") == F.col("conv_id"), Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    steps = steps.select("path", F.sum(F.when(mine, F.col("cost")).otherwise(0)).over(below).alias("cost"), F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(below).alias("leaf"))
    sums = steps.groupBy("path").agg(F.sum("leaf").alias("n_leaves"), F.sum("cost").alias("saved_tokens"))
    above = known.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return known.drop("words", "anchor").join(sums, "path").join(above, "parent", "left")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of conversations given as rows (conv_id, turn, digest, words), and as ids (conv_id), turnless ones too; see prefix_trie()."""
    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest").select("conv_id", "digest", "words")
    steps = written(placed.mapInArrow(_paths, "conv_id long, depth int, path binary, parent binary, anchor binary, words long, ends boolean"), "steps")
    same = [F.first(c).alias(c) for c in ("parent", "anchor", "depth", "words")]
    nodes = written(steps.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *same), "nodes")
    turnless = ids.join(steps.filter("depth = 1").select("conv_id"), "conv_id", "left_anti")
    # the root's path, empty, from a column: a join on a constant would have no key
    of_root = F.substring(F.col("conv_id").cast("string"), 1, 0).cast("binary").alias("path")
    ends = ends_digests(steps.filter("ends").select("path", "conv_id").unionByName(turnless.select(of_root, "conv_id")))

    shelves = 1 + nodes.count() // SHELF
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(of_root, F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    parts, waiting, pending = [], [root], nodes
    schema = f"path binary, parent binary, conv_id long, depth int, n_convs long, parent_conv_id long, {_SUMS}"
    for depth in range(1, ROUNDS + 1):
        sizes = pending.groupBy("anchor").count().filter(F.col("count") > MOST).select("anchor")
        large = written(sizes, "large")
        fit = pending.join(large, "anchor", "left_anti").withColumn("shelf", F.pmod(F.xxhash64("anchor"), F.lit(shelves)))
        parts.append(written(fit.groupBy("shelf").applyInPandas(_built, schema), "tries"))
        if large.isEmpty():
            pending = None
            break
        rest = pending.join(large, "anchor", "left_semi")
        waiting.append(rest.filter(F.col("depth") == depth).select("path", "parent", "conv_id", "depth", "n_convs", "words"))
        next_turn = steps.filter(F.col("depth") == depth + 1).select("conv_id", F.col("path").alias("anchor"))
        pending = written(rest.filter(F.col("depth") > depth).drop("anchor").join(next_turn, "conv_id").select(*nodes.columns), "pending")
    if pending is not None:
        parts.append(written(_along(pending, steps), "tries"))

    done = parts[0]
    for more in parts[1:]:
        done = done.unionByName(more)
    tops = done.filter("parent_conv_id IS NULL")
    split = None
    for level in reversed(waiting):  # each from the sums of the level below
        below = tops if split is None else tops.unionByName(split)
        sums = below.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).withColumnRenamed("parent", "path")
        own = (F.col("n_convs") - 1) * F.col("words")
        level = level.join(sums, "path", "left").select(
            "path", "parent", "conv_id", "depth", "n_convs", F.lit(None).cast("long").alias("parent_conv_id"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.coalesce("saved_tokens", F.lit(0).cast("long")) + own).alias("saved_tokens"),
        )
        level = written(level, "level")
        split = level if split is None else split.unionByName(level)
    above = split.select(F.col("path").alias("parent"), F.col("conv_id").alias("above"))
    outer = tops.unionByName(split).join(above, "parent", "left").withColumn("parent_conv_id", F.col("above")).drop("above")
    out = done.filter("parent_conv_id IS NOT NULL").unionByName(outer).join(ends, "path", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.hex("path").alias("node"), F.hex("parent").alias("parent_node"), "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """One row for each distinct sequence of first turns of conversations (conv_id, turn, role, text), the empty one too.

    node, parent_node (hex digests; the root's is empty, its parent null), conv_id (the smallest member: those that begin
    so; its first `depth` turns are the node's), depth, parent_conv_id, n_convs (members), n_children, n_leaves (nodes
    without children in its subtree, which it is part of), saved_tokens (over its subtree, each node's members but one
    times the words of its last turn), ends_sha256 (SHA-256 of the ids of members with no further turn, ascending, joined
    by commas).

    Turns are in order of turn, null first, then of a digest of role and text, so that repeated numbers and rows have a
    fixed order; repeated rows are turns of their own. Null roles and texts are empty. Rows without conv_id are in no
    conversation. An empty table has no node. Column names are given by conv_col, turn_col, role_col, text_col; other
    columns are not read. A conversation is read by one task, which holds one turn of it at a time.
    """
    turns = digested(conversations, **columns)
    return trie(turns, turns.select("conv_id").distinct())
