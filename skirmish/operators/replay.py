"""Ordered replay of purchases into the items held at the end, and legal schedules of item purchases."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Components = Mapping[int, Sequence[int]]


def depths(components: Components) -> dict[int, int]:
    """How many levels of components stand below each item."""

    @cache
    def of(item: int) -> int:
        return 1 + max((of(c) for c in components[item]), default=-1) if item in components and components[item] else 0

    return {item: of(item) for item in components}


def final_inventory(events: Iterable[tuple[int, int, int]], components: Components) -> tuple[int, ...]:
    """Items held at the end, sorted, from (item, buy time, sale time or 0).

    Within a second purchases come before sales, and simpler items before those made of them. A purchase uses up one copy of each component held; selling what isn't held changes nothing.
    """
    level = depths(components)
    steps = sorted([(t, 0, level.get(i, 0), i) for i, t, _ in events] + [(s, 1, 0, i) for i, _, s in events if s > 0])
    held: list[int] = []
    for _, is_sale, _, item in steps:
        for gone in (item,) if is_sale else components.get(item, ()):
            if gone in held:
                held.remove(gone)
        if not is_sale:
            held.append(item)
    return tuple(sorted(held))


def classify_events(events: Sequence[tuple[int, int, str, int]], components: Components, cost: Mapping[int, int]) -> list[tuple[int, str, int, int]]:
    """(time, kind, item, cash) of ordered (time, sequence, 'buy' or 'sell', item) events.

    Kinds: purchase, upgrade_purchase (cash less what the components cost), sale, and upgrade_consumption for a removal that an upgrade
    of the same second explains. Removing an item that was neither held nor used up in that second is an error.
    """
    held: list[int] = []
    used: dict[tuple[int, int], int] = {}
    out = []
    for time, _, kind, item in sorted(events):
        if kind == "buy":
            spent = [c for c in components.get(item, ()) if c in held]
            for c in spent:
                held.remove(c)
                used[time, c] = used.get((time, c), 0) + 1
            held.append(item)
            out.append((time, "upgrade_purchase" if spent else "purchase", item, max(0, cost[item] - sum(cost[c] for c in spent))))
        elif used.get((time, item)):
            used[time, item] -= 1
            out.append((time, "upgrade_consumption", item, 0))
        elif item in held:
            held.remove(item)
            out.append((time, "sale", item, 0))
        else:
            raise ValueError(f"item {item} is removed at {time} s but isn't held")
    return out


def final_inventories(purchases: DataFrame, owner: Sequence[str], components: Components) -> DataFrame:
    """(owner, items): :func:`final_inventory` for every owner. ``components`` is the item catalogue's graph, whose size doesn't depend on the matches.

    Spark groups and sorts; the fold sees one owner's short array at a time, in Arrow batches.
    """
    grouped = purchases.groupBy(*owner).agg(F.array_sort(F.collect_list(F.struct("item_id", "buy_time", "sold_time"))).alias("events"))
    schema = grouped.select(*owner, F.array().cast("array<bigint>").alias("items")).schema
    graph = {k: tuple(v) for k, v in components.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = batch.column("events").to_pylist()
            items = [final_inventory([(e["item_id"], e["buy_time"], e["sold_time"]) for e in x], graph) for x in events]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in owner], pa.array(items, pa.list_(pa.int64()))], [*owner, "items"])

    return grouped.mapInArrow(run, schema)


def incremental_cost(item: int, held: Sequence[int], components: Components, cost: Mapping[int, int]) -> int:
    """Cash for an item after credit for the components held, each once."""
    left, credit = list(held), 0
    for c in components.get(item, ()):
        if c in left:
            left.remove(c)
            credit += cost[c]
    return max(0, cost[item] - credit)


def schedule(targets: Sequence[int], components: Components, cost: Mapping[int, int], active: Iterable[int] = (), slots: int = 9, actives: int = 4) -> list[int] | None:
    """An order of purchases, components before what is made of them, that ends with exactly ``targets`` held and never exceeds the slots. None if there is none.

    Every purchase happens once, so a set is out of the question if it needs two copies of an item: one to hold, or to put into another product, besides
    the one that a product uses up. Orders are searched depth first. What is held depends only on what was bought so far, so a set of purchases
    from which the search failed once isn't tried again. Simpler and cheaper targets come first where the limits allow it.
    """
    active, level = set(active), depths(components)
    rank: dict[int, int] = {}
    uses: dict[int, int] = dict.fromkeys(targets, 1)
    if len(uses) < len(targets):
        return None

    def need(item: int) -> bool:
        for c in components.get(item, ()):
            uses[c] = uses.get(c, 0) + 1
            if uses[c] > 1 or not need(c):
                return False
        rank[item] = len(rank)
        return True

    if not all(need(t) for t in sorted(targets, key=lambda i: (level.get(i, 0), cost[i], i))):
        return None
    order = sorted(rank, key=rank.__getitem__)
    failed: set[frozenset[int]] = set()

    def go_on(bought: frozenset[int], held: frozenset[int], path: list[int]) -> list[int] | None:
        if len(path) == len(order):
            return path
        if bought in failed:
            return None
        for item in order:
            parts = components.get(item, ())
            if item not in bought and all(c in held for c in parts):
                now = held.difference(parts) | {item}
                if len(now) <= slots and len(active & now) <= actives:
                    found = go_on(bought | {item}, now, [*path, item])
                    if found:
                        return found
        failed.add(bought)
        return None

    return go_on(frozenset(), frozenset(), [])
