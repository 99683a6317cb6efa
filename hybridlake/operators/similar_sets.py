"""Pairs of similar sets of few, common elements, such as runs of three characters. Exact.

Where elements are few, every set's rarest ones are still common, and filters by them leave about all
pairs. So sets are compared in blocks, with sketches that bound from below how far two sets differ: a
task holds two blocks whatever the size of the table, and a comparison takes nanoseconds. Blocks are
ordered by the size of sets; those too unlike in size don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridlake.session import cut_lineage

#: Elements of one block at most, unless a single set has more, and the number of blocks aimed at in a small table.
_BLOCK, _BLOCKS = 6_000_000, 8
#: Rows and columns compared at once, and pairs handed on at once.
_ROWS, _COLUMNS, _HANDED = 64, 4096, 200_000


@dataclass(frozen=True)
class Similar:
    """members: (key, c) where c, the least key of equal sets, names their class; pairs: (c_a, c_b, similarity, more_a, more_b) of
    unlike classes, each pair once, more: whether the class has further members."""

    members: DataFrame
    pairs: DataFrame


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all elements, number of each row) of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


class _Block:
    """Classes of one block in order of size, their elements as places in the task's dictionary."""

    def __init__(self, batches: list[pa.RecordBatch], known: np.ndarray, bits: int) -> None:
        ids, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for b in batches:
            x, size = _values(b.column("xs"))
            ids.append(np.searchsorted(known, x).astype(np.int32))
            sizes.append(size)
        ids, self.n = np.concatenate(ids), np.concatenate(sizes)
        names = pa.chunked_array([b.column("c") for b in batches])
        more = np.concatenate([b.column("more").to_numpy(zero_copy_only=False) for b in batches])
        order = np.argsort(self.n, kind="stable")
        start = np.cumsum(self.n) - self.n
        self.n, self.start, self.ids, self.c, self.more = self.n[order], start[order], ids, names.take(pa.array(order)), more[order]
        bit = (_mix(known) % np.uint64(bits)).astype(np.int64)
        # A bit is the parity of its elements, so sketches differ in no more bits than sets in elements.
        self.sketch = np.zeros((len(order), bits // 64), np.uint64)
        for a in range(0, len(order), _COLUMNS):
            n = self.n[a : a + _COLUMNS]
            of = bit[self.ids[self.places(np.arange(a, a + len(n)))]]
            np.bitwise_xor.at(self.sketch, (np.repeat(np.arange(a, a + len(n)), n), of >> 6), np.uint64(1) << (of & 63).astype(np.uint64))

    def places(self, which: np.ndarray) -> np.ndarray:
        """Where the elements of some classes are, class by class."""
        n = self.n[which]
        return np.repeat(self.start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _close(a: _Block, b: _Block, t: float, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, similarity) of similar pairs; within one block each pair once."""
    marks = np.zeros(size, np.int64)
    columns = np.ascontiguousarray(b.sketch.T)
    for r in range(0, len(a.n), _ROWS):
        n = a.n[r : r + _ROWS, None]
        low, high = np.searchsorted(b.n, n[0, 0] * t - 1e-6), np.searchsorted(b.n, n[-1, 0] / t + 1e-6, "right")
        found = []
        for s in range(max(low, r + 1) if a is b else low, high, _COLUMNS):
            e = min(high, s + _COLUMNS)
            apart = np.zeros((len(n), e - s), np.uint16 if len(columns) < 1024 else np.uint32)
            for w in range(len(columns)):
                apart += np.bitwise_count(a.sketch[r : r + _ROWS, w, None] ^ columns[w, s:e])
            i, j = np.nonzero(apart <= (n + b.n[s:e]) * ((1 - t) / (1 + t)) + 1e-6)
            i, j = i + r, j + s
            found.append(np.stack([i[kept], j[kept]]) if a is b and len(kept := np.flatnonzero(j > i)) < len(i) else np.stack([i, j]))
        if not found:
            continue
        i, j = np.concatenate(found, axis=1)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for x in np.unique(i):
            mine = a.ids[a.start[x] : a.start[x] + a.n[x]]
            marks[mine] = 1
            every = j[np.searchsorted(i, x) : np.searchsorted(i, x, "right")]
            for p in range(0, len(every), _COLUMNS):
                others = every[p : p + _COLUMNS]
                common = np.add.reduceat(marks[b.ids[b.places(others)]], np.cumsum(b.n[others]) - b.n[others])
                similarity = common / (a.n[x] + b.n[others] - common)
                good = similarity >= t
                yield np.full(good.sum(), x), others[good], similarity[good]
            marks[mine] = 0


def _compared(t: float):
    """The two blocks of one task (sides 0 and 1), or one with itself, to pairs of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        known, longest = np.empty(0, np.uint64), 1
        for batch in batches:
            for side in (0, 1):
                part = batch.filter(pc.equal(batch.column("side"), side))
                if part.num_rows:
                    x, size = _values(part.column("xs"))
                    known, longest = np.union1d(known, x), max(longest, int(size.max()))
                    sides[side].append(part)
        if not sides[0]:
            return
        bits = 128
        while bits < min(2 * longest, 1 << 16):
            bits *= 2
        a = _Block(sides[0], known, bits)
        b = _Block(sides[1], known, bits) if sides[1] else a
        sides[0].clear()
        sides[1].clear()

        def handed(rows: list) -> pa.RecordBatch:
            i, j, s = (np.concatenate(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(side.c.take(pa.array(at)).combine_chunks() for side, at in ((a, i), (b, j))), pa.array(s), pa.array(a.more[i]), pa.array(b.more[j])], ["c_a", "c_b", "similarity", "more_a", "more_b"])

        rows, held = [], 0
        for one in _close(a, b, t, len(known)):
            rows.append(one)
            held += len(one[0])
            if held >= _HANDED:
                yield handed(rows)
                rows, held = [], 0
        if held:
            yield handed(rows)

    return run


def _blocks(sizes: list[tuple[int, int]], t: float, block: int | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """From (size, number of classes) in order: ((size, first block, number of blocks), (block, task, side), number of tasks)."""
    block = block or min(_BLOCK, max(50_000, sum(n * c for n, c in sizes) // _BLOCKS))
    of, bounds, held = [], [], 0
    for n, c in sizes:
        parts = -(-n * c // block)
        if parts > 1 or not bounds or held + n * c > block:
            of.append((n, len(bounds), parts))
            bounds += [[n, n] for _ in range(parts)]
            held = n * c if parts == 1 else block
        else:
            of.append((n, len(bounds) - 1, 1))
            bounds[-1][1] = n
            held += n * c
    tasks = [(i, j) for i in range(len(bounds)) for j in range(i, len(bounds)) if bounds[i][1] >= bounds[j][0] * t - 1e-6]
    return of, [x for k, (i, j) in enumerate(tasks) for x in ((i, k, 0), (j, k, 1)) if x[2] == 0 or i != j], len(tasks)


def similar(df: DataFrame, key: str, elements: str, threshold: float, block: int | None = None) -> Similar:
    """Sets with Jaccard similarity of at least the threshold. Empty sets, and rows without key or set, take no part.

    Elements are compared by a 64-bit hash, equal sets are found by one. What goes to the driver is a row
    for each size of set.
    """
    spark = df.sparkSession
    sets = df.select(F.col(key).alias("key"), F.sort_array(F.array_distinct(F.transform(elements, lambda x: F.xxhash64(x)))).alias("xs")).where("key is not null")
    # Filtered once they are written, as a filter below would make all sets twice.
    sets = cut_lineage(sets.withColumn("h", F.xxhash64("xs"))).where("size(xs) > 0")
    classes = sets.groupBy("h").agg(F.min("key").alias("c"), (F.min("key") != F.max("key")).alias("more"), F.first("xs").alias("xs"))
    named = classes.select("h", "c")
    of, meetings, tasks = _blocks([(r[0], r[1]) for r in classes.groupBy(F.size("xs").alias("n")).count().orderBy("n").collect()], threshold, block)
    members = sets.select("key", "h").distinct().join(named, "h").select("key", "c")
    kind = sets.schema["key"].dataType.simpleString()
    out = f"c_a {kind}, c_b {kind}, similarity double, more_a boolean, more_b boolean"
    if not tasks:
        return Similar(members, spark.createDataFrame([], out))
    placed = classes.withColumn("n", F.size("xs")).join(F.broadcast(spark.createDataFrame(of, "n int, first int, parts int")), "n").withColumn("block", F.col("first") + F.pmod("h", "parts").cast("int"))
    sent = placed.join(F.broadcast(spark.createDataFrame(meetings, "block int, task int, side int")), "block").select("task", "side", "c", "more", "xs")
    return Similar(members, sent.repartitionById(tasks, "task").mapInArrow(_compared(threshold), out))


def pairs_of_keys(s: Similar) -> DataFrame:
    """(key_a < key_b, similarity) of all members. Only pairs of classes with further members are joined to them."""
    close = cut_lineage(s.pairs)
    m = cut_lineage(s.members)
    x, y = m.select(F.col("key").alias("x"), F.col("c").alias("c_a")), m.select(F.col("key").alias("y"), F.col("c").alias("c_b"))
    single = close.where("not more_a and not more_b").select(F.col("c_a").alias("x"), F.col("c_b").alias("y"), "similarity")
    several = close.where("more_a or more_b").join(x, "c_a").join(y, "c_b").select("x", "y", "similarity").distinct()
    own = x.join(y, F.col("c_a") == F.col("c_b")).where("x < y").select("x", "y", F.lit(1.0).alias("similarity")).distinct()
    every = single.unionByName(several).unionByName(own).where("x != y")
    return every.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "similarity")


def losers(s: Similar, df: DataFrame, key: str, score: Column) -> DataFrame:
    """Keys that lose a pair: of every similar pair the lower score goes, of equal ones the greater key, and where a score is null
    the lesser key; marks don't spread. Classes are summed up, so pairs of keys are never formed."""
    m = s.members.join(df.select(F.col(key).alias("key"), score.alias("s")), "key")
    top = [F.max("s").alias("s"), F.max_by("least", "s").alias("least"), F.max("unknown").alias("unknown"), F.max("last").alias("last")]
    by_score = m.groupBy("c", "s").agg(F.min("key").alias("least"), F.max("key").alias("last")).withColumn("unknown", F.when(F.col("s").isNull(), F.col("last")))
    best = by_score.groupBy("c").agg(*top)
    near = s.pairs.select(F.explode(F.array(F.struct(F.col("c_a").alias("c"), F.col("c_b").alias("d")), F.struct(F.col("c_b").alias("c"), F.col("c_a").alias("d")))).alias("p")).select("p.c", "p.d")
    around = near.join(best.withColumnRenamed("c", "d"), "d").drop("d").unionByName(best)
    around = around.groupBy("c", "s").agg(F.min("least").alias("least"), F.max("unknown").alias("unknown"), F.max("last").alias("last")).groupBy("c").agg(*top)
    against = around.select("c", F.col("s").alias("best"), "least", "unknown", "last")
    known = (F.col("best") > F.col("s")) | ((F.col("best") == F.col("s")) & (F.col("least") < F.col("key"))) | (F.col("unknown") > F.col("key"))
    return m.join(against, "c").where(F.when(F.col("s").isNull(), F.col("last") > F.col("key")).otherwise(known)).select(F.col("key").alias(key)).distinct()
