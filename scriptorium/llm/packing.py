"""Filling containers of fixed capacity with texts (problem 8), best-two-fit.

Items are spread by hash over groups of a bounded size, each large enough that the last, part-filled container of a group doesn't count. Within a group a container
takes the largest item left and then, as long as one fits, the largest that fits. Then its smallest item gives way to two items left whose sum
fits the widened gap more tightly, if there are such. A text larger than the capacity is cut into full containers and a rest that is packed like any item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 20_000


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; every size is in 1..capacity."""
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in sorted(range(len(sizes)), key=lambda i: -i):
        left[sizes[i]].append(i)
    mask = 0
    for s, own in enumerate(left):
        if own:
            mask |= 1 << s
    out = []

    def take(s: int) -> int:
        nonlocal mask
        i = left[s].pop()
        if not left[s]:
            mask &= ~(1 << s)
        return i

    def give(s: int, i: int) -> None:
        nonlocal mask
        left[s].append(i)
        mask |= 1 << s

    while mask:
        items, gap = [], capacity
        while (fits := mask & ((2 << gap) - 1)) > 1:
            s = fits.bit_length() - 1
            items.append(take(s))
            gap -= s
        if gap and len(items) > 1 and mask:
            least = sizes[items[-1]]
            best, pair = least, None
            room = gap + least
            a_fits = mask & ((1 << room) - 1)
            while a_fits > 1:
                a = a_fits.bit_length() - 1
                if 2 * a <= best:
                    break
                b_fits = mask & ((2 << min(a, room - a)) - 1)
                b = b_fits.bit_length() - 1
                if b == a and len(left[a]) < 2:
                    b_fits &= ~(1 << a)
                    b = b_fits.bit_length() - 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a_fits &= ~(1 << a)
            if pair:
                out_item = items.pop()
                items += [take(pair[0]), take(pair[1])]
                give(least, out_item)
        out.append(items)
    return out


PACKED = pa.schema([("pack", pa.string()), ("bin", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int64()), ("tokens", pa.int64())])


def _group(t: pa.Table) -> pa.Table:
    """One group of one pack."""
    name, group, capacity = t.column("pack")[0].as_py(), t.column("group")[0].as_py(), t.column("capacity")[0].as_py()
    order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
    ids, tokens = t.column("doc_id").to_numpy()[order].tolist(), t.column("tokens").to_numpy()[order].tolist()
    rows, items, sizes, bins = [], [], [], 0
    for d, n in zip(ids, tokens):
        piece, at = 0, 0
        while n - at > capacity:
            rows.append((name, f"{group}-{bins}", d, piece, at, capacity))
            piece, at, bins = piece + 1, at + capacity, bins + 1
        items.append((d, piece, at))
        sizes.append(n - at)
    for own in pack(sizes, capacity):
        rows += [(name, f"{group}-{bins}", *items[i], sizes[i]) for i in own]
        bins += 1
    return pa.table([pa.array(c, ty) for c, ty in zip(zip(*rows), PACKED.types)], schema=PACKED)


def pack_texts(sizes: DataFrame, packs: DataFrame, group: int = GROUP) -> DataFrame:
    """(pack, bin, doc_id, piece, first_token, tokens): every text of `sizes(doc_id, tokens)` in containers of each `packs(pack, capacity_tokens)`.

    Every token of every text is in one container of each pack, and none is over-full. Texts within the capacity are in one piece. Rows without id
    or of no tokens are left out, as are packs without a positive capacity; a doc_id that comes twice is packed twice.
    """
    own = sizes.where("doc_id is not null and tokens > 0").select("doc_id", "tokens")
    n = own.count()
    groups = max(1, -(-n // group))
    kinds = packs.where("pack is not null and capacity_tokens > 0").groupBy("pack").agg(F.max("capacity_tokens").alias("capacity"))  # a handful
    spread = own.withColumn("group", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(groups)).cast("int")).crossJoin(F.broadcast(kinds))
    return spread.groupBy("pack", "group").applyInArrow(_group, "pack string, bin string, doc_id bigint, piece int, first_token bigint, tokens bigint")


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack, containers, texts, tokens, fill): how full the containers of each pack are."""
    total = packed.groupBy("pack", "bin").agg(F.sum("tokens").alias("t")).groupBy("pack").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    texts = packed.groupBy("pack").agg(F.countDistinct("doc_id").alias("texts"))
    return total.join(texts, "pack").join(packs, "pack").select("pack", "containers", "texts", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
