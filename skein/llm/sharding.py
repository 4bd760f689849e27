"""Sharding by balanced label propagation.

Rows with equal texts are linked. Heavy groups, of more than 1/HEAVY of all rows (a quarter of a shard), of which there are fewer than HEAVY whatever the input, start whole on a shard each: the largest first, where most room is; only those larger
than the room of any shard are cut, to as few parts as there can be. All other rows start on the shards in turn. In each round a Spark aggregation counts, for each linked group, its rows
on each shard, and a join lets its other rows ask for the shard where most of the group is. What is asked for is summed into a table of
shards x shards x 64 hash buckets; from it the driver (whose table has that size for any input) fixes which buckets may move, so that no shard gets more linked
rows than its quota: exchanges between two shards first, then moves into free room. Rows without links fill each shard up to its quota at the end,
so that shards have the same number of rows, give or take one.

Joins broadcast what belongs to hot groups, of which there are few, too.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm._shared import hot_join, row_at, written

SHARDS = 16
ROUNDS = 4
_BUCKETS = 64
HEAVY = 64


def _numbered(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """rows with a gapless number from 0 within each value of `by`, in the order of __row, without bringing a value's rows into one task.

    Rows are numbered within each input partition (the upper bits of __row); the partitions' counts, a few for each partition, are summed up before.
    """
    rows = rows.withColumn("__part", F.shiftright("__row", 33))
    counts = rows.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", *by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part", *by).orderBy("__row")) - 1
    return rows.withColumn("__within", within).join(offsets, ["__part", *by]).withColumn(out, (F.col("__before") + F.col("__within")).cast("bigint")).drop("__part", "__within", "__before")


def _allowed(asked: dict[tuple[int, int], dict[int, int]], held: list[int], quota: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, bucket) that may move: asked[from, to][bucket] rows ask to, held and quota are by shard."""
    moves, waiting = [], {}  # held is changed to what it is after the moves
    for (i, j), buckets in sorted(asked.items()):
        waiting[i, j] = sorted(buckets.items())
    for i, j in sorted(k for k in waiting if k[0] < k[1]):
        here, there = waiting[i, j], waiting.get((j, i), [])
        gone = {(i, j): 0, (j, i): 0}
        while here and there:  # take turns, the direction that is behind first, while both shards stay within their quotas
            way, queue = ((i, j), here) if gone[i, j] <= gone[j, i] else ((j, i), there)
            bucket, n = queue[0]
            if held[way[1]] + n > quota[way[1]]:
                break
            queue.pop(0)
            gone[way] += n
            held[way[0]] -= n
            held[way[1]] += n
            moves.append((*way, bucket))
    moved = True
    while moved:
        moved = False
        for (i, j), queue in sorted(waiting.items(), key=lambda x: (held[x[0][1]] - quota[x[0][1]], x[0])):
            while queue and held[j] + queue[0][1] <= quota[j]:
                bucket, n = queue.pop(0)
                held[i] -= n
                held[j] += n
                moves.append((i, j, bucket))
                moved = True
    return moves


def _by_room(room: list[int]) -> Column:
    """The shard of the row with number __rank, if each shard takes the next so many rows."""
    ends = list(itertools.accumulate(room))
    shard = F.lit(len(room) - 1)
    for j in reversed(range(len(room) - 1)):
        shard = F.when(F.col("__rank") < ends[j], F.lit(j)).otherwise(shard)
    return shard


def _packed(groups: list[tuple[bytes, int]], room: list[int]) -> list[tuple[bytes, int, int, int]]:
    """(group, first, end, shard): where rows first to end of each group go; room is lessened by them."""
    out = []
    for group, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        first = 0
        while first < n:
            j = max(range(len(room)), key=lambda j: (room[j], -j))
            taken = min(n - first, room[j])
            out.append((group, first, first + taken, j))
            room[j] -= taken
            first += taken
    return out


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, text: str = "text", heavy_share: int = HEAVY) -> DataFrame:
    """The columns of docs but the text, with size, text_crc32, shard (from 0) and slot (gapless from 0 within the shard).

    size is the text's UTF-8 bytes plus 1; null texts have none, and are linked with nothing. Empty texts are equal texts. Repeated rows are rows like others: each gets its place.
    An empty table gives no rows. Columns of docs with one of these names are replaced. heavy_share: groups of more than one in so many rows are packed whole; all others propagate.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (text, "size", "text_crc32", "shard", "slot")]
    rows = docs.select(
        *others,
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("text_crc32"),
        F.unhex(F.md5(text)).alias("__group"),
    )
    rows = written(row_at(rows, "__row"), "shard-rows")
    total = rows.count()
    if not total:
        return rows.select(*others, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    counts = rows.where("__group is not null").groupBy("__group").agg(F.count(F.lit(1)).alias("n"))
    heavy = [(bytes(g), n) for g, n in counts.where((F.col("n") > 1) & (F.col("n") * heavy_share > total)).collect()]  # fewer than heavy_share
    packed = spark.createDataFrame(_packed(heavy, quota), "__group binary, __first bigint, __end bigint, shard int")  # quota: what is left for others
    whole = rows.select("__row", "__group").join(F.broadcast(packed.select("__group").distinct()), "__group")
    whole = _numbered(whole, ["__group"], "__at").join(F.broadcast(packed), "__group").where("__at >= __first AND __at < __end")
    whole = written(whole.select("__row", "shard"), "shard-whole")
    others_ = rows.select("__row", "__group").join(F.broadcast(packed.select("__group").distinct()), "__group", "left_anti")
    state = _numbered(others_, [], "__rank")
    state = written(state.select("__row", F.xxhash64("__group").alias("__link"), _by_room(quota).alias("shard"), F.col("__group").isNotNull().alias("__has")), "shard-state")
    state = state.select("__row", F.when(F.col("__has"), F.col("__link")).alias("__link"), "shard")
    sizes = state.where("__link is not null").groupBy("__link").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    linked = written(hot_join(state, sizes, ["__link"], total).drop("n"), "shard-linked")
    full: list[int] = []  # shards without room after the last round; a group that isn't whole then tries for another
    for _ in range(rounds):
        tie = F.pmod(F.xxhash64("__link", "shard"), F.lit(1 << 20))
        best = linked.groupBy("__link", "shard").count().groupBy("__link").agg(
            F.sum("count").alias("n"), F.max("count").alias("__most"), F.max_by("shard", F.struct("count", tie)).alias("__first"), F.max_by("shard", F.struct(~F.col("shard").isin(full), "count", tie)).alias("__second")
        )
        stays = (F.col("__most") == F.col("n")) | ~F.col("__first").isin(full)
        best = best.select("__link", "n", F.when(stays, F.col("__first")).otherwise(F.col("__second")).alias("__to"))
        wants = hot_join(linked, best, ["__link"], total).drop("n").withColumn("__bucket", F.pmod(F.xxhash64("__link", F.lit(1)), F.lit(_BUCKETS)).cast("int"))
        asked: dict[tuple[int, int], dict[int, int]] = {}
        held = [0] * shards
        for i, j, bucket, n in wants.groupBy("shard", "__to", "__bucket").count().collect():  # at most shards * shards * 64 rows
            held[i] += n
            if i != j:
                asked.setdefault((i, j), {})[bucket] = n
        moves = _allowed(asked, held, quota)
        if not moves:
            break
        full = [j for j in range(shards) if held[j] >= quota[j] - quota[j] // 50]
        accepted = spark.createDataFrame(moves, "shard int, __to int, __bucket int").withColumn("__go", F.lit(True))
        linked = wants.join(F.broadcast(accepted), ["shard", "__to", "__bucket"], "left")
        linked = written(linked.select("__row", "__link", F.when(F.col("__go"), F.col("__to")).otherwise(F.col("shard")).alias("shard")), "shard-linked")
    held = [0] * shards
    for j, n in linked.groupBy("shard").count().collect():
        held[j] = n
    free = _numbered(state.join(linked, "__row", "left_anti").select("__row"), [], "__rank")
    free = free.select("__row", _by_room([q - h for q, h in zip(quota, held, strict=True)]).alias("shard"))
    placed = whole.unionByName(linked.select("__row", "shard")).unionByName(free)
    placed = _numbered(placed, ["shard"], "slot")
    return rows.join(placed, "__row").select(*others, "size", "text_crc32", "shard", "slot")


def cut_edges(placed: DataFrame, group: str) -> int:
    """Pairs of rows with an equal `group` that are on different shards."""
    counts = placed.where(F.col(group).isNotNull()).groupBy(group, "shard").count()
    pairs = counts.groupBy(group).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"))
    return int(pairs.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0))).first()[0])


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard. The law is `rows`: counts differ by one at most."""
    placed = assign(docs.select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
