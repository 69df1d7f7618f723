"""Conversation prefix trie by union-find over sorted neighbours.

A conversation is the sequence of its turns (role, text); every distinct
sequence of its first d turns is a node of depth d.

1. A turn becomes 20 bytes: the MD5 of role and text, and the text's length in
   code points. A conversation is its turns' bytes put together, so byte order
   sorts conversations with equal first turns side by side. Texts are read once
   and never shuffled.
2. A range exchange sorts all conversations; equal ones may lie in several
   partitions. Within a partition each pair of neighbours is an edge as deep as
   the turns they share (their longest common prefix). Edges are taken in
   descending depth; union-find merges the components at their ends, and every
   merge makes a branching node, or joins the node that is there at that depth.
3. Nodes between a component and its parent have the same members and are
   spelt out. Nodes on the path of a partition's first or last conversation may
   go on in the next partition: the forest is contracted to those two paths, with
   what hangs on them summed up, and the paths of all partitions are the
   conversations of the next round, until one partition holds them.
4. A node whose parent was finished in a later round gets the parent's smallest
   member by a join on (partition, parent), so a parent with very many children
   is no hot key. The ids that end at one node are joined in order and hashed;
   where they go over several partitions, strings of at most ``IDS`` ids are hashed
   in order as a stream.

Memory: a task holds the 20-byte turns of its conversations and of the paths; a
conversation's turns must fit in one row in this form (100 million turns do).

Nulls and edges: null roles and texts are empty; null turn numbers come first;
turns with equal numbers are ordered by the MD5 of role and text; repeated rows
are turns of their own. Rows without a conversation id belong to none and
are left out. An empty table has no nodes (not even a root). Other columns are
neither read nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import parts_for, written

#: Bytes of a turn; conversations of one partition at most (about); fewer are not split further.
TURN, ROWS, FEW = 20, 50_000, 500
#: Ids of one string of a node's ends.
IDS = 1000
_WEIGHTS = ("n", "kids", "leaves", "saved", "low")
_NO_ID = np.iinfo(np.int64).max
_OUT = ("kind int, key binary, parent_key binary, part string, place long, conv_id long, depth long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, seq binary, "
        + ", ".join(f"{w} array<long>" for w in _WEIGHTS))
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in _OUT.split(", "))])
NODE, PATH, IDS_OF_NODE = 0, 1, 2


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq): each conversation's turns in order, as hex digits (2 x TURN a turn)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    # the role's length parts it from the text
    record = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.lower(F.hex(F.length(text))), 8, "0"))
    own = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("_turn"), record.alias("_record"))
    order = F.struct(F.col("_turn").isNotNull(), F.coalesce("_turn", F.lit(0)), F.col("_record"))
    listed = own.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("_t"))
    return listed.select("conv_id", F.array_join(F.transform("_t", lambda t: t["_record"]), "").alias("seq"))


def rebuilt(own: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, seq): every conversation with its first h turns replaced by those of conversation c - c % every; h = crc32(c) % heads."""
    width = 2 * TURN
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.substring("seq", 1, width * (heads - 1)).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.withColumn("_base", F.col("conv_id") - F.col("conv_id") % every).withColumn("_h", h).join(first, "_base", "left")
    head = F.substring(F.coalesce("_head", F.lit("")), F.lit(1), F.col("_h") * width)
    rest = F.substring("seq", F.col("_h") * width + 1, F.length("seq"))
    return joined.select("conv_id", F.concat(head, rest).alias("seq"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two conversations share at the front."""
    lo, hi = 0, min(len(a), len(b)) // TURN
    if a[: hi * TURN] == b[: hi * TURN]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo * TURN: mid * TURN] == b[lo * TURN: mid * TURN]:
            lo = mid
        else:
            hi = mid
    return lo


def compressed(lcp: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, list[int], list[int], list[int], list[list[int]]]:
    """The tree over sorted sequences: for each node its depth, first and last sequence and children; parents come after children.

    ``lcp[i]`` is how deep sequences i and i + 1 agree, ``depth`` how long each is.
    """
    m = len(depth)
    at, lo, hi, kids = depth.tolist(), list(range(m)), list(range(m)), [[] for _ in range(m)]
    top, root = list(range(m)), list(range(m))  # the node on top of a component; union-find

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    alive = [True] * m
    for e in np.argsort(-lcp, kind="stable").tolist():
        d, a, b = int(lcp[e]), find(e), find(e + 1)
        x, y = top[a], top[b]
        if at[x] == d:
            if at[y] == d:  # both stand at this depth: one node
                kids[x] += kids[y]
                alive[y] = False
            else:
                kids[x].append(y)
            hi[x] = hi[y]
        elif at[y] == d:
            kids[y].insert(0, x)
            lo[y] = lo[x]
            x = y
        else:
            at.append(d)
            lo.append(lo[x])
            hi.append(hi[y])
            kids.append([x, y])
            alive.append(True)
            x = len(at) - 1
        root[b] = a
        top[a] = x
    return np.array(alive), at, lo, hi, kids


class _Paths:
    """MD5 of the first d turns of a sequence, for every d, by one pass over it."""

    def __init__(self, seq: bytes):
        h, self.keys = hashlib.md5(), []
        for d in range(len(seq) // TURN + 1):
            self.keys.append(h.digest())
            h.update(seq[d * TURN: (d + 1) * TURN])


def forest(seqs: list[bytes], weights: list[dict[str, np.ndarray]] | None, ids: np.ndarray | None, part: str, last: bool) -> Iterator[dict]:
    """Rows of one partition's trie: finished nodes, the two open paths, and the ids that end at open nodes.

    ``weights``: for each sequence arrays by depth of what hangs on it (members that end there or below closed nodes, closed
    children, their leaves, their saved tokens, smallest id); None for plain conversations, then ``ids`` has theirs.
    ``last``: no other partition, so all nodes are finished.
    """
    m = len(seqs)
    depth = np.array([len(s) // TURN for s in seqs])
    lcp = np.array([shared_turns(seqs[i], seqs[i + 1]) for i in range(m - 1)], dtype=np.int64)
    alive, at, lo, hi, kids = compressed(lcp, depth)
    nodes = [v for v in range(len(at)) if alive[v]]
    nodes.sort(key=lambda v: -at[v])  # children first
    above = {c: v for v in nodes for c in kids[v]}
    tops = [v for v in nodes if v not in above]
    assert len(tops) == 1
    paths: dict[int, _Paths] = {}

    def key_of(i: int, d: int) -> bytes:
        if i not in paths:
            if len(paths) > 64:
                paths.clear()
            paths[i] = _Paths(seqs[i])
        return paths[i].keys[d]

    ends = (0, m - 1)
    open_rows = {i: {w: np.zeros(depth[i] + 1, dtype=np.int64) for w in _WEIGHTS[:4]} | {"low": np.full(depth[i] + 1, _NO_ID)} for i in set(ends)}
    total = {}  # node -> (members, smallest id, leaves, saved) of the top of its chain, for finished ones
    for v in nodes:
        up = above.get(v)
        start = at[up] + 1 if up is not None else 0
        length = at[v] - start + 1
        is_open = not last and (lo[v] == 0 or hi[v] == m - 1)
        own = {w: np.zeros(length, dtype=np.int64) for w in _WEIGHTS[:4]} | {"low": np.full(length, _NO_ID)}
        if weights is None:
            stop = lo[v]
            while stop <= hi[v] and depth[stop] == at[v]:  # those that end here come first
                stop += 1
            mine = ids[lo[v]: stop]
            if len(mine):
                own["n"][-1], own["low"][-1] = len(mine), mine.min()
        else:
            for i in range(lo[v], hi[v] + 1):
                got = min(int(depth[i]) + 1, at[v] + 1) - start
                if got > 0:
                    for w in _WEIGHTS[:4]:
                        own[w][:got] += weights[i][w][start: start + got]
                    np.minimum(own["low"][:got], weights[i]["low"][start: start + got], out=own["low"][:got])
        for c in kids[v]:
            if c in total:  # a finished child
                n, low, leaves, saved = total[c]
                own["kids"][-1] += 1
                own["n"][-1] += n
                own["leaves"][-1] += leaves
                own["saved"][-1] += saved
                own["low"][-1] = min(own["low"][-1], low)
        if is_open:
            to = open_rows[0 if lo[v] == 0 else m - 1]
            for w in _WEIGHTS[:4]:
                to[w][start: at[v] + 1] += own[w]
            np.minimum(to["low"][start: at[v] + 1], own["low"], out=to["low"][start: at[v] + 1])
            if weights is None:
                for k in range(0, len(mine), IDS):
                    yield {"kind": IDS_OF_NODE, "key": key_of(lo[v], at[v]), "part": part, "place": k, "ends": ",".join(map(str, mine[k: k + IDS].tolist()))}
            continue
        # from the bottom of the chain up
        members, low = np.cumsum(own["n"][::-1])[::-1], np.minimum.accumulate(own["low"][::-1])[::-1]
        chars = np.array([int.from_bytes(seqs[lo[v]][d * TURN - 4: d * TURN], "big") if d else 0 for d in range(start, at[v] + 1)], dtype=np.int64)
        children = own["kids"].copy()
        children[:-1] += 1
        leaves = np.cumsum(own["leaves"][::-1])[::-1]
        if children[-1] == 0:
            leaves += 1
        saved = np.cumsum(((members - 1) * chars + own["saved"])[::-1])[::-1]
        total[v] = int(members[0]), int(low[0]), int(leaves[0]), int(saved[0])
        up_open = up is not None and not last and (lo[up] == 0 or hi[up] == m - 1)
        for j in range(length - 1, -1, -1):
            row = {"kind": NODE, "part": part, "conv_id": int(low[j]), "depth": start + j, "n_convs": int(members[j]), "n_children": int(children[j]),
                   "n_leaves": int(leaves[j]), "saved_tokens": int(saved[j])}
            if j:
                row["parent_conv_id"] = int(low[j - 1])
            elif up_open:
                row["parent_key"] = key_of(lo[v], start - 1)
            elif up is not None:
                row["place"] = up  # filled in below
            if weights is None:
                row["ends"] = hashlib.sha256((",".join(map(str, mine.tolist())) if j == length - 1 else "").encode()).hexdigest()
            else:
                row["key"] = key_of(lo[v], start + j)
            yield row | {"_node": v if j == length - 1 else -1}
    if not last:
        for i in sorted(set(ends)):
            if i == 0 or seqs[i] != seqs[0]:
                yield {"kind": PATH, "part": part, "seq": seqs[i], **{w: open_rows[i][w].tolist() for w in _WEIGHTS}}


def _batches(rows: Iterator[dict], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The rows as batches; a top node's parent (``place``) becomes the parent's smallest member."""
    rows = list(rows)
    low = {r["_node"]: r["conv_id"] for r in rows if r.get("_node", -1) >= 0}
    for a in range(0, len(rows), most):
        some = rows[a: a + most]
        for r in some:
            if r["kind"] == NODE and "place" in r:
                r["parent_conv_id"] = low[r.pop("place")]
        yield pa.RecordBatch.from_pylist(some, schema=_SCHEMA)


def _round(rows: DataFrame, level: int, last: bool, plain: bool) -> DataFrame:
    """One round over sorted partitions of ``rows`` (seq, and conv_id or weights)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        own = pa.Table.from_batches(held)
        seqs, part = own.column("seq").to_pylist(), own.column("_part")[0].as_py()
        weights, ids = None, None
        if plain:
            ids = own.column("conv_id").to_numpy()
        else:
            each = [[np.asarray(x.values) for x in own.column(w)] for w in _WEIGHTS]
            weights = [dict(zip(_WEIGHTS, x, strict=True)) for x in zip(*each, strict=True)]
        yield from _batches(forest(seqs, weights, ids, f"{level}:{part:09d}", last))

    return rows.withColumn("_part", F.spark_partition_id()).mapInArrow(run, _OUT)


def _joined_ids(chunks: DataFrame) -> DataFrame:
    """(key, ends): the SHA-256 of each open node's ids, read in order as a stream."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h = None, None
        for b in batches:
            done = []
            for k, ids in zip(b["key"], b["ends"], strict=True):
                k = bytes(k)
                if k == key:
                    h.update(b"," + ids.encode())
                else:
                    if key is not None:
                        done.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["key", "ends"])
        if key is not None:
            yield pd.DataFrame([(key, h.hexdigest())], columns=["key", "ends"])

    return chunks.repartition("key").sortWithinPartitions("key", "part", "place").select("key", "ends").mapInPandas(run, "key binary, ends string")


def trie(seqs: DataFrame) -> DataFrame:
    """All nodes of the conversations ``seqs`` (conv_id, seq in hex): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = seqs.sparkSession
    now = written(seqs.select("conv_id", F.unhex("seq").alias("seq")), "conversations")
    order, level, rounds = ["seq", "conv_id"], 0, []
    while True:
        n = now.count()
        spread = int(spark.conf.get("spark.sql.shuffle.partitions")) if level == 0 else 1
        parts = max(parts_for(n, ROWS), min(spread, n // FEW))
        last = parts <= 1
        dealt = (now.coalesce(1) if last else now.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
        done = written(_round(dealt, level, last, level == 0), f"trie-{level}")
        rounds.append(done)
        if last:
            break
        now, order, level = done.where(F.col("kind") == PATH).select("seq", *_WEIGHTS), ["seq"], level + 1
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if len(rounds) == 1:
        return rounds[0].where(F.col("kind") == NODE).select(*columns, F.col("ends").alias("ends_sha256"))
    # nodes of later rounds: keys, ends and smallest members
    nodes = [r.where(F.col("kind") == NODE) for r in rounds]
    later = nodes[1]
    for r in nodes[2:]:
        later = later.union(r)
    none = hashlib.sha256(b"").hexdigest()
    ends = _joined_ids(rounds[0].where(F.col("kind") == IDS_OF_NODE)).withColumnRenamed("ends", "_ends")
    later = written(later.drop("ends").join(ends, "key", "left").withColumn("ends", F.coalesce("_ends", F.lit(none))).drop("_ends"), "trie-open")
    all_nodes = nodes[0].unionByName(later.select(nodes[0].columns))
    wanted = all_nodes.where(F.col("parent_key").isNotNull()).select("part", "parent_key").distinct()
    parents = wanted.join(later.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")), "parent_key")
    filled = all_nodes.join(parents, ["part", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return filled.select(*columns, F.col("ends").alias("ends_sha256"))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of all conversations of ``turns`` as they are."""
    return trie(sequences(turns, conv_col, turn_col, role_col, text_col))
