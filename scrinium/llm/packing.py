"""Problem 7: fill containers of fixed capacity; a plan over the histogram of sizes, applied to all rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrinium.durable import durable
from scrinium.llm.tokens import TOKENIZERS, VOCABULARY, token_counts

CAPACITY = 4096
#: Parts over which rows of one size are ranked; it only sets the parallelism of a hot size.
SALT = 64


class Instance:
    """Counts by size, and the sizes that are left in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def take(self, size: int, n: int) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest items, one item of size ``without`` aside."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.counts[s] - (s == without))
            if len(out) >= k:
                break
        return out

    def largest_up_to(self, room: int, without: int) -> int:
        """Largest size of at most ``room``, one item of size ``without`` aside; 0 if there is none."""
        for k in range(bisect_right(self.sizes, room) - 1, -1, -1):
            if self.counts[self.sizes[k]] > (self.sizes[k] == without):
                return self.sizes[k]
        return 0


def reduce_dominated(own: Instance, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Martello and Toth's reduction: fix containers that dominate every other one for their largest item.

    For the largest item j: alone, if nothing fits beside it; with the largest item k that fits, if k fills the
    container or no two other items fit; with the best pair, if no three fit and that pair's parts dominate every
    single item and pair.  Each is fixed for as many items of those sizes as there are, at once.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    for j in reversed(list(own.sizes)):
        while own.counts.get(j, 0):
            room = capacity - j
            few = own.smallest(3, j)
            if not few or few[0] > room:
                n = own.counts[j]
                fixed.append(((j,), n))
                own.take(j, n)
                continue
            k = own.largest_up_to(room, j)
            if k == room or len(few) < 2 or few[0] + few[1] > room:
                n = own.counts[j] // 2 if k == j else min(own.counts[j], own.counts[k])
                fixed.append(((j, k), n))
                own.take(j, n)
                own.take(k, n)
                continue
            if len(few) < 3 or sum(few) > room:
                # pairs only: (k, b) with k the largest single dominates (a, b') if k >= a and b >= b' for all of them
                second = own.largest_up_to(room - k, j if k != j else -1)
                if second and (k != second or own.counts[k] > 1 + (k == j)) and own.largest_up_to(room - few[0], j) <= k and own.largest_up_to(room // 2, j) <= second:
                    need = Counter((j, k, second))
                    if all(own.counts[s] >= m for s, m in need.items()):
                        n = min(own.counts[s] // m for s, m in need.items())
                        fixed.append(((j, k, second), n))
                        for s, m in need.items():
                            own.take(s, m * n)
                        continue
            break
    return fixed


def best_fit(own: Instance, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: all equal containers take the next size at once."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[tuple, int]]] = {}

    def put(content: tuple, room: int, n: int) -> None:
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append((content, n))

    for s in reversed(list(own.sizes)):
        n = own.counts[s]
        own.take(s, n)
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                each = min(capacity // s, n)
                put((None, s, each), capacity - each * s, n // each)
                n -= n // each * each
                continue
            room = rooms[k]
            content, have = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            each = min(room // s, n)
            fit = min(have, n // each)
            if have > fit:
                put(content, room, have - fit)
            put((content, s, each), room - each * s, fit)
            n -= each * fit
    out = []
    for groups in open_.values():
        for content, n in groups:
            sizes: list[int] = []
            while content:
                content, s, each = content
                sizes += [s] * each
            out.append((tuple(reversed(sizes)), n))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (size, from, to, container, each, offset): of the items of ``size``, numbers from..to-1 go to containers from
    ``container`` on, ``each`` of them to one, the first at ``offset``.

    The instance is the histogram of sizes, so its length is bounded by the capacity, whatever the number of items.
    """
    own = Instance(counts)
    containers = reduce_dominated(own, capacity)
    containers += best_fit(own, capacity)
    used: Counter = Counter()
    rows, at = [], 0
    for sizes, n in containers:
        offset = 0
        for s, each in Counter(sizes).items():
            rows.append((s, used[s], used[s] + n * each, at, each, offset))
            used[s] += n * each
            offset += s * each
        at += n
    return rows


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Containers that any packing needs: by total size, and by items of which no two fit together."""
    total = -(-sum(s * n for s, n in counts.items()) // capacity)
    return max(total, sum(n for s, n in counts.items() if 2 * s > capacity))


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_token", capacity: int = CAPACITY) -> DataFrame:
    """(key, pezzo, inizio, n_token, contenitore, posto): every row in a container, whole unless larger than one.

    A row of more than ``capacity`` is cut into full pieces and a rest; ``pezzo`` counts them and ``inizio`` is the
    first token of each.  Full pieces fill a container each.  All others go by the plan that ``plan`` makes of the
    counts by size, which is all that the driver gets (at most ``capacity`` rows).  Rows are ranked within their
    size in ``SALT`` parts, so that a hot size isn't ranked by one task, and find their place by a search in the plan.  ``posto`` is the place in the container.
    Rows of size 0 or null come out in container -1, which is empty; repeated keys are packed one by one.
    """
    spark = sizes.sparkSession
    rows = sizes.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("s"))
    whole, rest = F.floor(F.col("s") / capacity), F.col("s") % capacity
    cut = F.when(F.col("s") <= capacity, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("a"), F.col("s").alias("n")))).otherwise(
        F.transform(F.sequence(F.lit(0), (whole - (rest == 0).cast("long")).cast("int")), lambda p: F.struct(p.alias("p"), (p.cast("long") * capacity).alias("a"), F.least(F.lit(capacity).cast("long"), F.col("s") - p.cast("long") * capacity).alias("n")))
    )
    pieces = rows.select("k", F.explode(cut).alias("x")).select("k", "x.*").withColumn("h", F.pmod(F.xxhash64("k", "p"), F.lit(SALT)).cast("int"))
    pieces = durable(pieces)
    by = pieces.filter("n > 0").groupBy("n", "h").agg(F.count("*").alias("c"))
    before = by.select("n", "h", (F.sum("c").over(Window.partitionBy("n").orderBy("h")) - F.col("c")).alias("before"))
    counts = {int(r.n): int(r.c) for r in by.groupBy("n").agg(F.sum("c").alias("c")).collect()}
    where = _places(spark.sparkContext.broadcast(np.array(plan(counts, capacity), np.int64).reshape(-1, 6)))
    ranked = pieces.filter("n > 0").withColumn("r", F.row_number().over(Window.partitionBy("n", "h").orderBy("k", "p", "a")) - 1)
    ranked = ranked.join(before, ["n", "h"]).select("k", "p", "a", "n", where("n", F.col("r") + F.col("before")).alias("w"))
    placed = ranked.select(F.col("k").alias(key), F.col("p").alias("pezzo"), F.col("a").alias("inizio"), F.col("n").alias("n_token"), "w.contenitore", "w.posto")
    empty = pieces.filter("n = 0").select(F.col("k").alias(key), F.col("p").alias("pezzo"), F.col("a").alias("inizio"), F.col("n").alias("n_token"), F.lit(-1).cast("long").alias("contenitore"), F.lit(0).cast("long").alias("posto"))
    return placed.unionByName(empty)


def _places(held):
    """Expression (size, number) -> (contenitore, posto) by a search in the plan, whose length depends on the sizes only."""

    def find(sizes: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = held.value
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        n, r = sizes.to_numpy(np.int64), numbers.to_numpy(np.int64)
        first = np.searchsorted(rows[:, 0], n)
        # within a size the starts ascend: the last one at or before the number, by bisection in all rows at once
        low, high = first, np.searchsorted(rows[:, 0], n, side="right")
        while (open_ := high - low > 1).any():
            middle = (low + high) // 2
            up = open_ & (rows[np.minimum(middle, len(rows) - 1), 1] <= r)
            low, high = np.where(up, middle, low), np.where(open_ & ~up, middle, high)
        own = rows[low]
        k = r - own[:, 1]
        return pd.DataFrame({"contenitore": own[:, 3] + k // own[:, 4], "posto": own[:, 5] + n * (k % own[:, 4])})

    return F.pandas_udf(find, "contenitore long, posto long")


def pack_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pack`` for texts, whose sizes are their numbers of tokens; each text is encoded once."""
    return pack(token_counts(df, key, text, folder, vocabulary), key, "n_token", capacity)


def split_rows(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of what was cut into pieces, which lie in containers of their own; each key once."""
    return packed.groupBy(key).agg(F.max("pezzo").alias("p"), F.min("contenitore").alias("c")).filter("p > 0 AND c >= 0").select(key)
