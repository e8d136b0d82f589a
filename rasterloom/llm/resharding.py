"""Sharding by minimum-cost flow from old shards to new capacities.

The law is `rows`: the new shards' row counts differ by one at most. Keeping a row in its place costs nothing, moving
it costs its bytes. A shard that must give up rows gives its smallest, so each such shard has a cut: the size of the
last row that may have to go. Cuts are found exactly, by counting sizes in ever narrower ranges; below a cut every row
moves, above it none does, and at it all rows cost the same. From these zones the driver solves a minimum-cost flow,
which says how many rows of which zone go from which old shard to which new one and which shards get the odd rows. As
the only choice is among rows of one size, the bytes moved are the fewest possible.

Old shards are what a column says (a number, or by default the names in `source`, numbered in order); old shard i stays
in place as new shard i. Rows of old shards beyond the new ones all move, so they are planned as one supply, however many such shards there are.
Of over MAX_OLD sources, those with the most rows are shards (ties: by name); the rows of smaller ones lie in no shard and move.

Rows equal in old shard, doc_id, size and checksum are counted first and planned as one row with a number, cut into pieces no
larger than a block, so equal rows crowd no task. Rows are numbered within blocks (old shard, zone, sub-block), so a task orders one block and not one shard; blocks move
whole, in order, and only a block that a boundary cuts is split. There are about BLOCKS of them at any size, which
bounds what the driver plans and what is broadcast.

Edge cases: a null text counts no bytes (size 8) and has the crc32 of an empty text; very long texts count all their
bytes; a null doc_id is ordered first; a null source is the name ""; a null number lies in no shard and moves; repeated
rows are rows of their own, with slots of their own in no particular order; an empty table gives no rows; new shards
may be more or fewer than the old; extra columns, whatever their names, are left alone (but see rewrite_affected).
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.llm.textcore import free_name
from rasterloom.storage import only, written

ROW_BYTES = 8
NEW_SHARDS = 24
#: About as many blocks are made, of at least LEAST_BLOCK rows.
BLOCKS, LEAST_BLOCK = 50_000, 256
#: Sources that are old shards of their own.
MAX_OLD = 1024
#: Equal keys that a rewrite orders in one task; more are spread.
CROWD = 65_536
#: Bits by which a range of sizes is narrowed at a time.
_BITS = 10
#: Bytes of a file that a rewrite aims at.
FILE_BYTES = 256 << 20


class _Flow:
    """Successive shortest paths with potentials on a small graph of integer capacities and costs."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)
        self.nodes: dict[object, int] = {}

    def node(self, name: object) -> int:
        return self.nodes.setdefault(name, len(self.nodes))

    def edge(self, a: object, b: object, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[self.node(x)].append(len(self.to))
            self.to.append(self.node(y))
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: object, sink: object) -> None:
        s, t = self.node(source), self.node(sink)
        height = [0] * len(self.nodes)
        while True:
            far, via = {s: 0}, {}
            heap, done = [(0, s)], set()
            while heap:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] > 0 and v not in done:
                        x = d + self.cost[e] + height[u] - height[v]
                        if x < far.get(v, x + 1):
                            far[v], via[v] = x, e
                            heapq.heappush(heap, (x, v))
            if t not in done:
                return
            most = max(far.values())
            for v in range(len(height)):
                height[v] += far.get(v, most)
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def solve(supply: dict[tuple[int, int], tuple[int, int]], shards: int, home: dict[int, int]) -> dict[tuple[int, int], dict[int, int]]:
    """Rows of each (old shard, zone) that each new shard gets, moving the fewest bytes.

    `supply` holds (rows, bytes); `home` the new shard that stands where an old one stood. Rows of a zone count
    as its mean size, rounded.
    """
    total = sum(rows for rows, _ in supply.values())
    floor, odd = divmod(total, shards)
    flow, used = _Flow(), {}
    for key, (rows, size) in sorted(supply.items()):
        if not rows:
            continue
        flow.edge("source", ("from", key), rows, 0)
        stay = home.get(key[0])
        if stay is not None:
            used[key, stay] = flow.edge(("from", key), ("shard", stay), rows, 0)
        used[key, None] = flow.edge(("from", key), "moving", rows, max(1, round(size / rows)))
    for j in range(shards):
        flow.edge("moving", ("shard", j), total, 0)
        flow.edge(("shard", j), "sink", floor, 0)
        flow.edge(("shard", j), "odd", 1, 0)
    flow.edge("odd", "sink", odd, 0)
    flow.run("source", "sink")
    need = {}
    for j in range(shards):
        here = flow.nodes["shard", j]
        need[j] = sum(flow.room[e ^ 1] for e in flow.out[here] if e % 2 == 0) - sum(flow.room[e ^ 1] for (_, to), e in used.items() if to == j)
    out: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
    for (key, to), e in used.items():
        if to is not None and flow.room[e ^ 1]:
            out[key][to] = flow.room[e ^ 1]
    for (key, to), e in used.items():  # what moves, is dealt to shards in order
        left = flow.room[e ^ 1] if to is None else 0
        while left:
            j = next(j for j in range(shards) if need[j])
            n = min(left, need[j])
            out[key][j] = out[key].get(j, 0) + n
            need[j] -= n
            left -= n
    return dict(out)


def block_plan(blocks: list[tuple[int, int, int, int, int]], shards: int, home: dict[int, int]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(old, zone, sub, low, high, shard, slot): rows low..high of a block go to a shard from that slot on.

    `blocks` holds (old, size_class, sub, rows, bytes). Blocks are dealt whole while they fit.
    """
    supply: dict[tuple[int, int], tuple[int, int]] = defaultdict(lambda: (0, 0))
    for old, cls, _, rows, size in blocks:
        n, b = supply[old, cls]
        supply[old, cls] = (n + rows, b + size)
    dealt, plan, filled = solve(supply, shards, home), [], [0] * shards
    for key, group in itertools.groupby(sorted(blocks), key=lambda b: b[:2]):
        quota = sorted(dealt.get(key, {}).items())
        for old, cls, sub, rows, _ in group:
            low = 0
            while low < rows:
                shard, left = quota[0]
                n = min(left, rows - low)
                plan.append((old, cls, sub, low, low + n, shard, filled[shard]))
                filled[shard] += n
                low += n
                quota[0] = (shard, left - n)
                if left == n:
                    quota.pop(0)
    return plan


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def numbered(documents: DataFrame, old: Column | None = None) -> DataFrame:
    """`documents` with `__old`: the number of the shard that a row lies in now, -1 for none."""
    if old is not None:
        return documents.withColumn("__old", F.coalesce(old.cast("int"), F.lit(-1)))
    name = F.coalesce("source", F.lit(""))
    most = documents.groupBy(name.alias("name")).count().orderBy(F.desc("count"), "name").limit(MAX_OLD)
    names = _small(documents.sparkSession, [(n, i) for i, n in enumerate(sorted(r["name"] for r in most.collect()))], "__name string, __at int")
    return documents.join(F.broadcast(names), name == F.col("__name"), "left").withColumn("__old", F.coalesce("__at", F.lit(-1))).drop("__name", "__at")


def _crc() -> Column:
    return F.crc32(F.coalesce("text", F.lit("")).cast("binary"))


def measured(documents: DataFrame, old: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32 and the old shard of each row; texts stay behind."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    return numbered(documents, old).select("doc_id", size.alias("size"), _crc().alias("text_crc32"), F.col("__old").alias("old"))


def cut_sizes(rows: DataFrame, goes: dict[int, int]) -> dict[int, int]:
    """For each old shard in `goes` the size of its k-th smallest row, k being goes[shard]; each of `rows` stands for n."""
    spark, low, bits, need = rows.sparkSession, dict.fromkeys(goes, 0), dict.fromkeys(goes, 40), dict(goes)
    while any(bits.values()):
        ranges = _small(spark, [(i, low[i], bits[i], max(bits[i] - _BITS, 0)) for i in goes], "old int, low long, bits int, step int")
        held = rows.join(F.broadcast(ranges), "old").filter(F.expr("size >= low and shiftright(size - low, bits) = 0"))
        bins = defaultdict(list)
        for i, k, n in held.groupBy("old", F.expr("shiftright(size - low, step)").alias("bin")).agg(F.sum("n").alias("n")).collect():  # at most 2^_BITS a shard
            bins[i].append((k, n))
        for i in goes:
            bits[i] = max(bits[i] - _BITS, 0)
            for k, n in sorted(bins[i]):
                if need[i] <= n:
                    low[i] += k << bits[i]
                    break
                need[i] -= n
    return low


def reshard(documents: DataFrame, old: Column | None = None, shards: int = NEW_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, old, shard, slot, moved, grown_shard for each row.

    `old` is the number of the shard a row lies in now, from 0; by default each `source` is a shard.
    """
    spark = documents.sparkSession
    same = measured(documents, old).groupBy("old", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    rows = written(same.withColumn("from", F.col("old")).withColumn("old", F.expr(f"case when old between 0 and {shards - 1} then old else -1 end")), "sizes")
    count = {r["old"]: r["n"] for r in rows.groupBy("old").agg(F.sum("n").alias("n")).collect()}  # at most one more than new shards
    total = sum(count.values())
    home = {i: i for i in count if i >= 0}
    cuts = cut_sizes(rows, {i: count[i] - total // shards for i in home if count[i] > total // shards})
    table = _small(spark, [(i, cuts.get(i)) for i in count], "old int, cut long")
    zoned = rows.join(F.broadcast(table), "old").withColumn("zone", F.expr("case when cut is null or size < cut then 0 when size = cut then 1 else 2 end"))
    most = max(LEAST_BLOCK, -(-total // BLOCKS))
    subs = [(i, z, -(-n // most)) for i, z, n in zoned.groupBy("old", "zone").agg(F.sum("n")).collect()]  # three zones a shard
    pieces = zoned.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {most})"))).withColumn("n", F.least(F.lit(most), F.col("n") - F.col("piece") * most))
    dealt = pieces.join(F.broadcast(_small(spark, subs, "old int, zone int, subs long")), ["old", "zone"]).withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32", "piece"), "subs").cast("int"))
    blocks = [tuple(r) for r in dealt.groupBy("old", "zone", "sub").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("b")).collect()]
    moves = _small(spark, block_plan(blocks, shards, home), "old int, zone int, sub int, low long, high long, shard int, base long")
    order = Window.partitionBy("old", "zone", "sub").orderBy("doc_id", "text_crc32", "size", "from", "piece").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("end", F.sum("n").over(order)).withColumn("start", F.expr("end - n"))
    met = ranked.join(F.broadcast(moves), ["old", "zone", "sub"]).filter("start < high and end > low")
    placed = met.withColumn("rank", F.explode(F.sequence(F.greatest("low", "start"), F.least("high", "end") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("from").alias("old"), "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"), (F.col("from") != F.col("shard")).alias("moved"), F.lit(None).cast("int").alias("grown_shard"))


def _key(doc_id: Column, crc: Column, old: Column) -> list[Column]:
    return [doc_id.isNull().alias("__none"), F.coalesce(doc_id, F.lit(0)).alias("__id"), crc.alias("__crc"), old.alias("__from")]


_KEY = ["__none", "__id", "__crc", "__from"]


def _crowded() -> Column:
    return F.element_at("__quota", -1).upto > CROWD


def _counted(rows: DataFrame, crowds: bool) -> DataFrame:
    """The rows with `__nth`, from 1, among those of their key. Keys with many rows are numbered in parts, from a table that holds each row's place."""
    nth = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.xxhash64("__row")))
    if not crowds:
        return rows.withColumn("__nth", nth)
    table = written(rows.filter(_crowded()).withColumn("__at", F.monotonically_increasing_id()), "crowds")
    parts = F.ceil(F.element_at("__quota", -1).upto / CROWD)
    many = table.withColumn("__piece", F.pmod(F.xxhash64("__at"), parts))
    before = F.sum("n").over(Window.partitionBy(*_KEY).orderBy("__piece")) - F.col("n")
    offsets = many.groupBy(*_KEY, "__piece").agg(F.count("*").alias("n")).withColumn("__before", before).drop("n")
    within = F.row_number().over(Window.partitionBy(*_KEY, "__piece").orderBy("__at"))
    spread = many.withColumn("__nth", within).join(offsets, [*_KEY, "__piece"]).withColumn("__nth", F.col("__nth") + F.col("__before"))
    few = rows.filter(~_crowded()).withColumn("__nth", nth)
    return few.unionByName(spread.select(*few.columns))


def rewrite_affected(documents: DataFrame, placed: DataFrame, path: str, old: Column | None = None) -> list[int]:
    """Writes, under path/shard=N, the rows of every new shard that gains or loses rows; returns those shards.

    Shards that keep exactly their old rows are not rewritten. `placed` is reshard() of the same documents, with the
    same `old`. Names of the documents may clash with those of `placed`; where they have a column `shard`, it stays and
    the folders are called shard_=N (and so on). Rows equal in doc_id, text and old shard are dealt to their shards in
    the order of a hash of all their columns, or of their places in a table if there are more than CROWD of them.
    """
    folder = free_name("shard", documents.columns)
    with only(documents.sparkSession):
        placed = written(placed, "placed")
        touched = placed.filter("moved").select(F.explode(F.array("old", "shard")).alias("shard")).filter("shard >= 0").distinct()
        shards = sorted(r["shard"] for r in touched.collect())  # at most as many as there are shards
        size = F.sum("size") if "size" in placed.columns else F.lit(0)
        files = [(j, max(1, -(-int(b or 0) // FILE_BYTES))) for j, b in placed.groupBy("shard").agg(size).collect()]
        mine = placed.filter(F.col("shard").isin(shards)).select(*_key(F.col("doc_id"), F.col("text_crc32"), F.col("old")), "shard")
        # of each key how many rows go to which shard: a list no longer than there are shards
        upto = F.sum("n").over(Window.partitionBy(*_KEY).orderBy("shard"))
        quotas = mine.groupBy(*_KEY, "shard").agg(F.count("*").alias("n")).withColumn("upto", upto).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("__quota"))
        rows = numbered(documents, old).select(F.struct(*documents.columns).alias("__row"), *_key(F.col("doc_id"), _crc(), F.col("__old")))
        # all rows of a key lie in shards that are rewritten, or none does
        joined = rows.join(quotas.hint("shuffle_hash"), _KEY)
        dealt = _counted(joined, not quotas.filter(_crowded()).isEmpty()).select("__row.*", F.expr("filter(__quota, q -> q.upto >= __nth)[0].shard").alias(folder))
        parts = F.broadcast(_small(documents.sparkSession, files, "__to int, __files int"))
        spread = dealt.join(parts, F.col(folder) == F.col("__to")).withColumn("__part", F.pmod(F.xxhash64("doc_id", "text"), "__files"))
        spread.repartition(folder, "__part").select(*documents.columns, folder).write.mode("overwrite").partitionBy(folder).parquet(path)
    return shards
