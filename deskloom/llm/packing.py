"""Problem 8: filling containers of fixed capacity with items that aren't split.

Items are spread by hash over blocks of bounded size; each block is divided by
multiway Karmarkar-Karp differencing: partial partitions with the largest imbalance
are merged with their loads opposed, so that windows come out nearly equal. The
number of windows starts at its lower bound and rises whenever a window exceeds the
capacity and can't be relieved by moving items into room left elsewhere. An item larger than the capacity fills whole containers of its own, and
its remainder is an item like others.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.runtime import cut, small

#: Windows and items of a block at most: more fill windows better, at a cost that grows faster than their number.
BLOCK_WINDOWS, BLOCK_ITEMS = 192, 8192


def differencing(sizes: list[int], k: int) -> tuple[list[int], list[list[int]]]:
    """Loads and members of ``k`` windows by the largest differencing method, fullest first.

    A partial partition is the ascending list of its windows that hold
    something; taking in a single item costs one insertion.
    """
    first: list[int] = []  # a window of two or more items is a node with two children
    second: list[int] = []
    n = len(sizes)

    def joined(x: tuple[int, int], y: tuple[int, int]) -> tuple[int, int]:
        first.append(x[1])
        second.append(y[1])
        return x[0] + y[0], n + len(first) - 1

    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        # the largest of b meet the empty windows of a, the others its least full ones
        meet = max(0, len(b) - (k - len(a)))
        pairs = [joined(a[i], b[meet - 1 - i]) for i in range(meet)]
        del a[:meet]
        for w in (*pairs, *b[meet:]) if len(b) < 8 else ():
            bisect.insort(a, w)
        if len(b) >= 8:
            a = sorted([*a, *pairs, *b[meet:]])
        heapq.heappush(heap, (-(a[-1][0] - (a[0][0] if len(a) == k else 0)), count, a))
        count += 1
    windows_ = heap[0][2][::-1] if heap else []
    members = []
    for _, node in windows_:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += (first[x - n], second[x - n])
        members.append(out)
    empty = k - len(windows_)
    return [load for load, _ in windows_] + [0] * empty, members + [[] for _ in range(empty)]


def relieve(loads: list[int], members: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]] | None:
    """Windows within ``capacity`` after moving items out of those that exceed it into the tightest room elsewhere, if that works."""
    loose = []
    for w, load in enumerate(loads):
        if load > capacity:
            own = sorted(members[w], key=lambda i: sizes[i])
            while load > capacity:
                out = next((i for i in own if sizes[i] >= load - capacity), own[-1])
                own.remove(out)
                loose.append(out)
                load -= sizes[out]
            members[w], loads[w] = own, load
    rooms = sorted((capacity - load, w) for w, load in enumerate(loads))
    for i in sorted(loose, key=lambda i: -sizes[i]):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            return None
        room, w = rooms.pop(at)
        members[w] = [*members[w], i]
        bisect.insort(rooms, (room - sizes[i], w))
    return members


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of the fewest windows that differencing, and moving single items out of full ones, keeps within ``capacity``; every size is at most that."""
    if not sizes:
        return []
    k = max(-(-sum(sizes) // capacity), sum(s > capacity / 2 for s in sizes), 1)
    while k < len(sizes):
        loads, members = differencing(sizes, k)
        if loads[0] <= capacity or (members := relieve(loads, members, sizes, capacity)):
            return [m for m in members if m]
        k += 1
    return [[i] for i in range(len(sizes))]


def pack(items: DataFrame, specs: DataFrame, *, key: str, size: str, block_windows: int = BLOCK_WINDOWS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``spec_name, container, <key>, piece, start, tokens``: where each item, or piece of one, lies.

    ``specs`` is a handful of rows ``spec_name, capacity_tokens``. Items of size
    0 or null and items without a key need no container; specs without a
    positive capacity have none. Repeated rows are items of their own.
    """
    rows = cut(items.where(F.col(key).isNotNull() & (F.col(size) > 0)).select(F.col(key).alias("item"), F.col(size).cast("long").alias("n"), F.monotonically_increasing_id().alias("row")))
    n, room = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = [(r["spec_name"], int(r["capacity_tokens"])) for r in specs.where("capacity_tokens > 0").distinct().collect()]
    blocks = {name: max(1, -(-room // (capacity * block_windows)), -(-n // block_items)) for name, capacity in wanted}
    plans = small(rows.sparkSession.createDataFrame([(name, capacity, blocks[name]) for name, capacity in wanted], "spec_name string, capacity long, blocks long"))
    planned = rows.crossJoin(plans)  # a fixed handful of specs
    full = planned.where("n >= capacity").select("spec_name", "item", "row", F.explode(F.sequence(F.lit(0), (F.col("n") / F.col("capacity")).cast("long") - 1)).alias("piece"), "capacity")
    whole = full.select("spec_name", F.concat_ws("-", F.lit("full"), "row", "piece").alias("container"), F.col("item").alias(key), F.col("piece").cast("long").alias("piece"), (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("tokens"))
    rest = planned.where("n % capacity > 0").select("spec_name", "capacity", "blocks", "item", "row", F.floor(F.col("n") / F.col("capacity")).cast("long").alias("piece"), (F.col("n") % F.col("capacity")).alias("tokens"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    kind = rows.schema["item"].dataType.simpleString()

    def one(key_: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["tokens", "row"], ascending=[False, True]).reset_index(drop=True)
        at = np.zeros(len(block), np.int64)
        for w, members in enumerate(windows(block["tokens"].tolist(), int(block["capacity"].iloc[0]))):
            at[members] = w
        out = block[["spec_name", "item", "piece", "tokens"]].copy()
        out["container"] = [f"{key_[1]}-{w}" for w in at]
        out["start"] = block["piece"] * block["capacity"]
        return out[["spec_name", "container", "item", "piece", "start", "tokens"]]

    # an explicit number of partitions: adaptive merging goes by bytes, and these blocks are small but cost time
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(sum(blocks.values()), 20_000))
    packed = rest.repartition(parts, "spec_name", "block").groupBy("spec_name", "block").applyInPandas(one, f"spec_name string, container string, item {kind}, piece long, start long, tokens long")
    return whole.unionByName(packed.withColumnRenamed("item", key))


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, tokens in them and the share of their room that is used."""
    held = packed.groupBy("spec_name", "container").agg(F.sum("tokens").alias("tokens"))
    sums = held.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return sums.join(small(specs.select("spec_name", "capacity_tokens")), "spec_name").withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
