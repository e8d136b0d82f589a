"""The prefix trie of conversations, with subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns. Nodes are told by a 128-bit sum over their turns: each turn's role and
text, hashed by SHA-256, give two 64-bit halves, each is hashed with its place, and the sums along a conversation name its
prefixes. Sums along a conversation or a path are taken by blocks, then over block totals, so no task holds a whole
conversation.

Subtree sums: every node's child with the most members is its heavy child (of several, the one with the smallest conv_id), and
heavy edges join to paths, each ending in a leaf. A light child has at most half its parent's members, so a path
lies under at most log2(conversations) others. A path is named by the smallest member of its leaf and
reaches up to the last light node on that conversation, so its nodes are an array by depth. Paths' totals go to
the paths above them in that many rounds at most; then each path's total is put on the node it hangs from, and one
suffix sum along the arrays gives every node its subtree.

Defined cases: rows with a null conv_id belong to no conversation. A null role or text is an empty one. Turns of
equal number follow one another by role and text (by the first 16 characters of the role, the first 32 of the text,
then a hash); equal rows all count. `c % 5` has the sign of c. An empty table has no nodes, not even the root. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.joins import lookup, small
from rasterloom.llm.textcore import lean, take
from rasterloom.storage import only, written

#: What is rebuilt from what: conversations take their first turns from the one at the multiple of GROUP below, fewer than MOST.
GROUP, MOST = 5, 9
#: Places of a conversation or a path that are summed in one group.
BLOCK = 4096
#: Conversation numbers, as a power of two, that are listed in one row.
_LISTED = 10
_KEY = ["d", "k0", "k1"]


def running(rows: DataFrame, group: str, along: str, values: list[str], down: bool = False) -> DataFrame:
    """`values` as sums over the rows of a group up to each row, in the order of `along` (falling if `down`); (group, along) is unique.

    Blocks of BLOCK places are summed apart; only groups of several blocks need what goes before.
    """
    sorts: Callable[[str], Column] = F.desc if down else F.asc
    blocked = rows.withColumn("_block", F.floor(F.col(along) / BLOCK))
    so_far = lambda keys, by, upto: Window.partitionBy(*keys).orderBy(sorts(by)).rowsBetween(Window.unboundedPreceding, upto)
    totals = blocked.groupBy(group, "_block").agg(*(F.sum(v).alias(v) for v in values))
    before = totals.select(group, "_block", *(F.sum(v).over(so_far([group], "_block", -1)).alias(f"_before_{v}") for v in values)).filter(F.col(f"_before_{values[0]}").isNotNull())
    within = blocked.withColumns({v: F.sum(v).over(so_far([group, "_block"], along, 0)) for v in values})
    joined = within.join(small(written(before, "blocks")), [group, "_block"], "left")
    return joined.withColumns({v: F.col(v) + F.coalesce(f"_before_{v}", F.lit(0)) for v in values}).drop("_block", *(f"_before_{v}" for v in values))


def _numbered(batches):
    """Sorted rows with `seq`, which rises over all partitions, and `place`, counted from 0 within each partition's stretch of a conversation."""
    part, n, last, run = TaskContext.get().partitionId() << 40, 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.asarray(take(batch, "conv_id"))
        at = np.arange(len(ids))
        new = np.concatenate([[last is None or ids[0] != last], ids[1:] != ids[:-1]])
        place = at - np.maximum.accumulate(np.where(new, at, -run))
        last, run = ids[-1], int(place[-1]) + 1
        digest = np.frombuffer(b"".join(take(batch, "digest").to_pylist()), "<i8").reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([take(batch, "conv_id"), pa.array(part + n + at), pa.array(place), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), take(batch, "n_bytes")], names=["conv_id", "seq", "place", "t0", "t1", "n_bytes"])
        n += len(ids)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, t0, t1, n_bytes): every turn with its place in its conversation, from 0.

    Rows are dealt out by ranges of (conv_id, turn, ...), so a long conversation lies in several partitions; what goes before
    a partition's first conversation is a table of at most one row a partition.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.left(role, F.lit(16)).alias("r"),
        F.left(text, F.lit(32)).alias("x"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "r", "x", "digest", "row"]
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(parts.mapInArrow(lean(_numbered), "conv_id long, seq long, place long, t0 long, t1 long, n_bytes long"), "turns")
    part = F.shiftright("seq", 40).alias("part")
    ends = local.groupBy(part).agg(F.min_by("conv_id", "seq").alias("head"), F.max_by(F.struct("conv_id", "place"), "seq").alias("tail"))
    # in each partition before its own, a conversation that goes on is the tail
    tails = ends.select(F.col("tail.conv_id").alias("conv_id"), "part", (F.col("tail.place") + 1).alias("n"))
    heads = ends.filter("head <> tail.conv_id").select(F.col("head").alias("conv_id"), "part", F.lit(0).cast("long").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tails.union(heads).select("conv_id", "part", F.sum("n").over(before).alias("ahead")).filter("ahead > 0")
    placed = local.withColumn("part", part).join(small(written(offsets, "offsets")), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("ahead", F.lit(0))).alias("place"), "t0", "t1", "n_bytes")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rebuilt conversations (c, total), and their turns (c, d, t0, t1, n_bytes, total), d from 1."""
    counts = placed.groupBy("conv_id").agg(F.count("*").alias("own"))
    own = counts.select(F.col("conv_id").alias("c"), "own", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).alias("h"))
    bases = counts.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.least("own", F.lit(MOST)).alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = written(own.join(bases, "base", "left").select("c", "base", "own", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    first = placed.filter((F.col("place") < MOST) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    lent = first.join(convs.select("c", "base", "h", "total"), "base").filter("place < h").select("c", (F.col("place") + 1).alias("d"), "t0", "t1", "n_bytes", "total")
    rows = convs.agg(F.sum("own")).first()[0] or 0
    kept = lookup(placed.withColumnRenamed("conv_id", "c"), convs.select("c", "h", "taken", "total", "own"), ["c"], "own", rows).filter("place >= h")
    return convs.select("c", "total"), lent.union(kept.select("c", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("d"), "t0", "t1", "n_bytes", "total"))


#: The digits of a prefix's 128 bits, 32 each, as sums of them fit 64 bits.
_LANES = ["s0", "s1", "s2", "s3"]


def _packed(high: Column, low: Column) -> Column:
    mask = (1 << 32) - 1
    return F.shiftleft(high.bitwiseAND(mask), 32).bitwiseOR(low.bitwiseAND(mask))


def prefixes(turned: DataFrame) -> DataFrame:
    """(c, total, d, k0, k1, p0, p1, n_bytes): every prefix of at least a turn, its key, and the key of its parent."""
    own = {}
    for k, half in enumerate(("t0", "t1")):
        hashed = F.xxhash64("d", half)
        own |= {f"w{2 * k}": F.shiftrightunsigned(hashed, 32), f"w{2 * k + 1}": hashed.bitwiseAND((1 << 32) - 1)}
    lanes = turned.withColumns(own).select("c", "total", "d", "n_bytes", *own, *(F.col(w).alias(s) for w, s in zip(own, _LANES, strict=True)))
    summed = running(lanes, "c", "d", _LANES)
    now, last = [F.col(s) for s in _LANES], [F.col(s) - F.col(w) for s, w in zip(_LANES, own, strict=True)]
    return summed.select("c", "total", "d", _packed(*now[:2]).alias("k0"), _packed(*now[2:]).alias("k1"), _packed(*last[:2]).alias("p0"), _packed(*last[2:]).alias("p1"), "n_bytes")


def _parent(df: DataFrame, *columns: str | Column) -> DataFrame:
    """`columns` by the key of each row's parent."""
    return df.select((F.col("d") - 1).alias("d"), F.col("p0").alias("k0"), F.col("p1").alias("k1"), *columns)


def _nodes(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """Every node: its key, its parent's, n_convs, conv_id, n_bytes, n_children, and whether it is a light child."""
    some = steps.groupBy(*_KEY).agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.max("n_bytes").alias("n_bytes"), F.max("p0").alias("p0"), F.max("p1").alias("p1"))
    zero = lambda name: F.lit(0).cast("long").alias(name)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id")).filter("n_convs > 0").select(*map(zero, _KEY), "n_convs", "conv_id", zero("n_bytes"), F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("p1"))
    nodes = written(some.unionByName(root), "nodes")
    size = F.struct("n_convs", F.bitwise_not("conv_id").alias("low"), "k0", "k1")
    families = written(_parent(nodes.filter("d > 0"), size.alias("size")).groupBy(*_KEY).agg(F.count("*").alias("n_children"), F.max("size").alias("heavy")), "families")
    heavy = families.select((F.col("d") + 1).alias("d"), F.col("heavy.k0").alias("k0"), F.col("heavy.k1").alias("k1"), F.lit(False).alias("light"))
    joined = nodes.join(families.select(*_KEY, "n_children"), _KEY, "left").join(heavy, _KEY, "left")
    return joined.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "light": F.coalesce("light", F.col("d") > 0)})


def _on_paths(nodes: DataFrame, steps: DataFrame, rows: int) -> DataFrame:
    """The nodes with their `path`, and the depth of its `top`."""
    flags = nodes.filter("d > 0").select(*_KEY, "light", F.when(F.col("n_children") == 0, F.col("conv_id")).alias("owner"), "n_convs")
    marked = written(lookup(steps.select("c", *_KEY), flags, _KEY, "n_convs", rows).select("c", *_KEY, "light", (F.col("owner") == F.col("c")).alias("ends")), "marked")
    top = F.coalesce(F.max(F.when(F.col("light"), F.col("d"))), F.lit(0))
    owners = written(marked.groupBy("c").agg(top.alias("top"), F.max("ends").alias("ends"), F.count("*").alias("steps")).filter("ends").select("c", "top", "steps"), "owners")
    own = lookup(marked.select("c", *_KEY), owners, ["c"], "steps", rows).filter("d >= top").select(*_KEY, F.col("c").alias("path"), "top")
    # the root lies on the path that no light node ends
    zero = [F.lit(0).cast("long").alias(k) for k in _KEY]
    root = owners.filter("top = 0").select(*zero, F.col("c").alias("path"), "top").union(nodes.filter("d = 0 and n_children = 0").select(*_KEY, F.col("conv_id").alias("path"), F.lit(0).cast("long")))
    return nodes.join(own.union(root), _KEY)


def _subtrees(placed: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of every node's subtree, from nodes on paths with what they hang from."""
    saved = ((F.col("n_convs") - 1) * F.col("n_bytes")).cast("long")
    tops = placed.filter("d = top").select("path", "parent_path", "d", "p0", "p1")
    paths = written(placed.groupBy("path").agg(F.sum(saved).alias("saved")).join(tops, "path"), "paths")
    # a path's own sums, then those of paths a step below it, two steps below, and so on
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    step = paths.select("path", F.lit(1).cast("long").alias("leaves"), "saved")
    every = step
    while True:
        up = step.join(paths.filter("parent_path is not null").select("path", "parent_path"), "path")
        step = written(up.groupBy(F.col("parent_path").alias("path")).agg(*sums), "step")
        if step.isEmpty():
            break
        every = every.union(step)
    whole = every.groupBy("path").agg(*sums)
    hung = _parent(whole.join(paths.filter("d > 0").select("path", "d", "p0", "p1"), "path"), "leaves", "saved").groupBy(*_KEY).agg(*sums)
    weighed = placed.join(hung, _KEY, "left").withColumns({"n_leaves": F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.coalesce("saved", F.lit(0)) + saved}).drop("leaves", "saved")
    return running(weighed, "path", "d", ["n_leaves", "saved_tokens"], down=True)


def _listed(batches):
    """The SHA-256 of each key's lists, joined by commas; rows come sorted by key and list number."""
    key, digest, out = None, None, []
    for batch in batches:
        for *now, text in zip(*(take(batch, c).to_pylist() for c in (*_KEY, "text")), strict=True):
            if now != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if len(out) >= 10_000:
            yield _told(out)
            out = []
    if key is not None:
        out.append((*key, digest.hexdigest()))
    yield _told(out)


def _told(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*_KEY, "ends_sha256"])


def _ends(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end. Numbers are listed by ranges first, so a crowded node is a few rows."""
    zero = [F.lit(0).cast("long").alias(k) for k in _KEY]
    ended = steps.filter("d = total").select(*_KEY, "c").union(convs.filter("total = 0").select(*zero, "c"))
    lists = ended.groupBy(*_KEY, F.shiftright("c", _LISTED).alias("list")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("text"))
    return lists.repartition(*_KEY).sortWithinPartitions(*_KEY, "list").mapInArrow(lean(_listed), "d long, k0 long, k1 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt `conversations` (conv_id, turn, role, text).

    Columns: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = conversations.sparkSession
    with only(spark) as results:
        convs, turned = rebuilt(turns(conversations))
        steps = written(prefixes(turned), "prefixes")
        rows = steps.count()
        nodes = written(_nodes(convs, steps), "nodes")
        placed = written(_on_paths(nodes, steps, rows), "placed")
        above = placed.filter("n_children > 0").select(*_KEY, F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"), "n_children")
        children = lookup(placed.filter("d > 0").withColumnsRenamed({"d": "own_d", "k0": "own_k0", "k1": "own_k1", "n_children": "own_children"}).select("*", (F.col("own_d") - 1).alias("d"), F.col("p0").alias("k0"), F.col("p1").alias("k1")), above, _KEY, "n_children", rows)
        children = children.drop(*_KEY).withColumnsRenamed({"own_d": "d", "own_k0": "k0", "own_k1": "k1", "own_children": "n_children"})
        root = placed.filter("d = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "parent_path": F.lit(None).cast("long")})
        summed = _subtrees(written(children.unionByName(root), "hung"))
        empty = hashlib.sha256(b"").hexdigest()
        done = summed.join(_ends(convs, steps), _KEY, "left").select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
        out = written(done, "trie")
        results.append(out)
    return out
