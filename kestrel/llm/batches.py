"""Filling batches of fixed capacity with texts of varying length.

1. *Histogram.*  Sizes (estimated tokens) of all items per model; a text larger
   than a batch is split into full pieces and a rest, no other text is split.
2. *Buckets.*  Dynamic programming over the histogram chooses the length
   boundaries that minimise padding to the boundary; every size may be one.
3. *Batches.*  Token-budget batches form inside each bucket, from the longest
   to the shortest: a bucket's items meet only batches of their own bucket, in
   decreasing size, each going where most room is left.
4. *Top-up* (the default; ``top_up=False`` leaves it out).  Before a bucket
   forms batches of its own, its items fill the room that batches of longer
   buckets have left, from the bucket next to it upwards, longest items first.
5. *Assignment.*  Every item learns its batch from its rank among the items of
   its size; ranks are counted in salted parts whose number grows with the
   items, so a size that a third of all items share is spread over many tasks.

The plan's size depends on the capacities, not on the number of items.

Defined results: null texts are no items, empty texts have size 1; repeated
rows (same chunk_id) are one item; models with a null or non-positive capacity
or item limit get no batches; ties are broken by chunk_id; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import materialized

BUCKETS = 8
#: Items of one size and model that one task ranks, about; with fewer than SALTS times as many, SALTS tasks share them.
RANKED_TOGETHER, SALTS = 500_000, 64


def boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with least total padding; sizes ascend.

    Every size may be a boundary.  The best last bucket begins no earlier for a
    larger end, so each round halves the ends and the starts to look at.
    """
    n = len(sizes)
    if n == 0:
        return []
    c = np.concatenate([[0], np.cumsum(counts)])
    t = np.concatenate([[0], np.cumsum(counts * sizes)])
    best = c[1:] * sizes - t[1:]  # padding of sizes 0..j in one bucket
    back: list[np.ndarray] = []
    for b in range(1, min(buckets, n)):
        new, at = best.copy(), np.zeros(n, dtype=np.int64)
        todo = [(b, n - 1, b, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j, last) + 1)
            total = best[i - 1] + (c[j + 1] - c[i]) * sizes[j] - (t[j + 1] - t[i])
            k = int(total.argmin())
            new[j], at[j] = total[k], i[k]
            todo += [(lo, j - 1, first, int(i[k])), (j + 1, hi, int(i[k]), last)]
        back.append(at)
        best = new
    cuts, j = [n - 1], n - 1
    for at in reversed(back):
        j = int(at[j]) - 1
        cuts.append(j)
    return [int(sizes[k]) for k in sorted(cuts)]


class Room:
    """Batches of one bucket that can take more, in groups of alike ones: the group with most room first."""

    def __init__(self):
        self.heap: list[tuple[int, int, list[int]]] = []
        self.order = 0

    def add(self, first: int, many: int, room: int, items: int) -> None:
        if many > 0 and room > 0 and items > 0:
            self.order += 1
            heapq.heappush(self.heap, (-room, self.order, [first, many, room, items]))

    def take(self, size: int) -> list[int] | None:
        """The group with most room, if an item of this size fits."""
        return heapq.heappop(self.heap)[2] if self.heap and -self.heap[0][0] >= size else None


class Plan:
    """Segments (size, first rank, last rank, first batch, items of that size per batch), and what the batches hold."""

    def __init__(self, hist: dict[int, int], capacity: int, max_items: int, buckets: int = BUCKETS, top_up: bool = True):
        self.capacity, self.max_items = capacity, max_items
        sizes = np.array(sorted(hist), dtype=np.int64)
        self.bounds = boundaries(sizes, np.array([hist[s] for s in sizes.tolist()], dtype=np.int64), buckets)
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.batches = 0
        #: first batch of each bucket, longest bucket first
        self.first_batch: list[int] = []
        rooms: list[Room] = []
        low = [0, *self.bounds[:-1]]
        for under, upper in zip(reversed(low), reversed(self.bounds)):
            mine = [s for s in reversed(sizes.tolist()) if under < s <= upper]
            left = {s: (hist[s], 0) for s in mine}  # how many are left, rank of the next
            if top_up:
                for room in reversed(rooms):
                    for s in mine:
                        left[s] = self._fill(room, s, *left[s])
            self.first_batch.append(self.batches)
            own = Room()
            for s in mine:
                many, rank = self._fill(own, s, *left[s])
                if many:
                    per = min(capacity // s, max_items)
                    full = -(-many // per)
                    own.add(self.batches, full, capacity, max_items)
                    self.batches += full
                    self._fill(own, s, many, rank)
            rooms.append(own)

    def _fill(self, room: Room, s: int, many: int, rank: int) -> tuple[int, int]:
        """Items of one size into a bucket's batches as long as they fit; (how many are left, rank of the next)."""
        back = []
        while many and (g := room.take(s)):
            first, batches, free, items = g
            per = min(free // s, items)
            whole = min(batches, many // per)
            rest = many - whole * per if whole < batches else 0
            for at, count, each in ((first, whole, per), (first + whole, 1 if rest else 0, rest)):
                if count:
                    self.segments.append((s, rank, rank + count * each, at, each))
                    back.append((at, count, free - s * each, items - each))
                    rank, many = rank + count * each, many - count * each
            used = whole + (rest > 0)
            room.add(first + used, batches - used, free, items)
        for g in back:  # only now, so that a batch is asked once per size
            room.add(*g)
        return many, rank


def items(chunks: DataFrame, models: DataFrame) -> DataFrame:
    """(model_name, chunk_id, part, size): what is to be packed, one row per piece."""
    one = (
        chunks.where("chunk_id is not null and text is not null").groupBy("chunk_id").agg(F.max(F.greatest(F.lit(1), F.floor(F.length("text") / 3))).alias("tokens"))
    )
    rows = models.where("capacity_tokens > 0 and max_items > 0 and model_name is not null").dropDuplicates(["model_name"]).collect()  # a handful of models
    m = [F.struct(F.lit(r.model_name).alias("model_name"), F.lit(r.capacity_tokens).cast("bigint").alias("capacity_tokens")) for r in rows]
    if not m:
        return one.select(F.lit("").alias("model_name"), "chunk_id", F.lit(0).alias("part"), F.lit(0).alias("size")).where("false")
    each = one.select("chunk_id", "tokens", F.explode(F.array(*m)).alias("m")).select("chunk_id", "tokens", "m.*")
    pieces = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    return each.select("model_name", "chunk_id", "tokens", "capacity_tokens", F.explode(F.sequence(F.lit(1), pieces)).alias("part")).select(
        "model_name", "chunk_id", F.col("part").cast("int").alias("part"),
        F.least("capacity_tokens", F.col("tokens") - (F.col("part") - 1) * F.col("capacity_tokens")).cast("int").alias("size"),
    )


def plans(sized: DataFrame, models: DataFrame, buckets: int = BUCKETS, top_up: bool = True) -> tuple[dict[str, Plan], int]:
    """A plan per model, and the items of the commonest size; the driver sees one count per model and size, at most the sum of the capacities."""
    hist: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("model_name", "size").agg(F.count("*").alias("n")).toLocalIterator():
        hist.setdefault(r.model_name, {})[r["size"]] = r.n
    rows = models.where("capacity_tokens > 0 and max_items > 0").dropDuplicates(["model_name"]).collect()
    made = {r.model_name: Plan(hist.get(r.model_name, {}), r.capacity_tokens, r.max_items, buckets, top_up) for r in rows}
    return made, max((n for h in hist.values() for n in h.values()), default=0)


def ranked(sized: DataFrame, salts: int = SALTS) -> DataFrame:
    """Items with their rank (from 0) among the items of their model and size, counted in salted parts."""
    s = sized.withColumn("salt", F.pmod(F.xxhash64("chunk_id", "part"), F.lit(salts)).cast("int"))
    per = s.groupBy("model_name", "size", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("model_name", "size").orderBy("salt")) - F.col("n")
    offsets = per.select("model_name", "size", "salt", before.alias("before"))
    w = Window.partitionBy("model_name", "size", "salt").orderBy("chunk_id", "part")
    return s.withColumn("k", F.row_number().over(w) - 1).join(offsets, ["model_name", "size", "salt"]).select(
        "model_name", "chunk_id", "part", "size", (F.col("k") + F.col("before")).alias("rank")
    )


_OUT = pa.schema([("model_name", pa.string()), ("chunk_id", pa.int64()), ("part", pa.int32()), ("size", pa.int32()), ("batch_id", pa.int64())])


def _assign(batches, tables):
    by = tables.value
    for b in batches:
        names = np.array(b.column("model_name").to_pylist(), dtype=object)
        size, rank = b.column("size").to_numpy().astype(np.int64), b.column("rank").to_numpy().astype(np.int64)
        batch = np.zeros(len(size), np.int64)
        for name in set(names.tolist()):
            key, first, start, per = by[name]
            at = np.flatnonzero(names == name)
            k = np.searchsorted(key, size[at] * (1 << 40) + rank[at], side="right") - 1
            batch[at] = start[k] + (rank[at] - first[k]) // per[k]
        yield pa.RecordBatch.from_arrays([b.column("model_name"), b.column("chunk_id"), b.column("part"), b.column("size"), pa.array(batch)], schema=_OUT)


def packed(chunks: DataFrame, models: DataFrame, buckets: int = BUCKETS, top_up: bool = True) -> DataFrame:
    """(model_name, chunk_id, part, size, batch_id) of every piece."""
    sized = materialized(items(chunks, models), "items")  # slim rows, read for the histogram and for the ranks: texts are read once
    made, most = plans(sized, models, buckets, top_up)
    tables = {}
    for name, p in made.items():
        seg = np.array(sorted(p.segments), dtype=np.int64).reshape(-1, 5)
        tables[name] = (seg[:, 0] * (1 << 40) + seg[:, 1], seg[:, 1], seg[:, 3], np.maximum(1, seg[:, 4]))
    shared = chunks.sparkSession.sparkContext.broadcast(tables)
    salts = max(SALTS, -(-most // RANKED_TOGETHER))
    return ranked(sized, salts).mapInArrow(partial(_assign, tables=shared), "model_name string, chunk_id bigint, part int, size int, batch_id bigint")


def report(chunks: DataFrame, models: DataFrame, buckets: int = BUCKETS, top_up: bool = True) -> DataFrame:
    """Per model: batches made, the least number possible, tokens, share of room left over; from the assignment itself."""
    cap = models.select("model_name", "capacity_tokens", "max_items").dropDuplicates(["model_name"])
    per = packed(chunks, models, buckets, top_up).groupBy("model_name", "batch_id").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    return (
        per.join(cap, "model_name")
        .groupBy("model_name", "capacity_tokens", "max_items")
        .agg(F.count("*").alias("n_batches"), F.sum("n").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest"), F.max("n").alias("most_items"))
        .withColumn("least_batches", F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity_tokens")), F.ceil(F.col("n_items") / F.col("max_items"))))
        .withColumn("room_left", F.round(1 - F.col("n_tokens") / (F.col("n_batches") * F.col("capacity_tokens")), 6))
    )


def totals(chunks: DataFrame, models: DataFrame) -> DataFrame:
    """Per model, from the assignment: pieces, tokens, texts that were split, batches beyond a limit (none)."""
    cap = models.select("model_name", "capacity_tokens", "max_items").dropDuplicates(["model_name"])
    made = packed(chunks, models)
    per = made.groupBy("model_name", "batch_id").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"), F.sum((F.col("part") == 2).cast("int")).alias("split"))
    over = (F.col("tokens") > F.col("capacity_tokens")) | (F.col("n") > F.col("max_items"))
    return per.join(cap, "model_name").groupBy("model_name").agg(
        F.sum("n").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.sum("split").alias("n_split"), F.sum(over.cast("int")).alias("n_overfull")
    )


TOTALS_SQL = """
WITH one AS (SELECT chunk_id, max(greatest(1, length(text) // 3)) AS t FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id),
m AS (SELECT DISTINCT model_name, capacity_tokens AS c FROM embed_models WHERE capacity_tokens > 0 AND max_items > 0)
SELECT model_name, sum(ceil(t / c::DOUBLE))::BIGINT AS n_items, sum(t)::BIGINT AS n_tokens, sum(CASE WHEN t > c THEN 1 ELSE 0 END)::BIGINT AS n_split, 0::BIGINT AS n_overfull
FROM one, m GROUP BY model_name
"""
