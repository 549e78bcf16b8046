"""Sharding by a hierarchical weighted hash tree.

Shards hang under racks and racks under regions. A key descends from the root:
at each level every child draws -ln(u) / weight, u a hash of the key and the
child's name, and the smallest draw wins, so children get keys in proportion to
their weights. If a weight changes, draws of other children stay as they were,
so keys move only into or out of the subtree whose weight changed. Shards beyond
the base layout come as regions of their own: one more shard is one more
region, and the only keys that move go into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked

#: Regions and racks of the base layout; shards are dealt to racks as evenly as it goes.
BASE_SHARDS, REGIONS, RACKS = 40, 4, 2


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int = -1


def branch(name: str, children: list[Node]) -> Node:
    """An inner node; its weight is the sum of its children's."""
    return Node(name, sum(c.weight for c in children), tuple(children))


def layout(shards: int, base: int = BASE_SHARDS, weights: dict[int, float] | None = None) -> Node:
    """The tree for a number of shards. Shards from `base` on are regions of their own."""
    weight = lambda s: float((weights or {}).get(s, 1.0))
    core, places = min(shards, base), REGIONS * RACKS
    regions = []
    for r in range(REGIONS):
        racks = []
        for k in range(RACKS):
            own = [s for s in range(base) if s * places // base == r * RACKS + k and s < core]
            leaves = [Node(f"shard-{s}", weight(s), shard=s) for s in own if weight(s) > 0]
            if leaves:
                racks.append(branch(f"rack-{r}-{k}", leaves))
        if racks:
            regions.append(branch(f"region-{r}", racks))
    for s in range(base, shards):
        if weight(s) > 0:
            regions.append(branch(f"region-s{s}", [branch(f"rack-s{s}", [Node(f"shard-{s}", weight(s), shard=s)])]))
    return branch("root", regions)


def levels(root: Node) -> list[list[list[tuple[str, float, int]]]]:
    """For each level, for each node of the level above, its children: name, weight, index in the level (at the leaves: shard)."""
    out, above = [], [root]
    while above[0].children:
        below, table = [], []
        for node in above:
            table.append([(c.name, c.weight, c.shard if not c.children else len(below) + k) for k, c in enumerate(node.children)])
            below += node.children
        out.append(table)
        above = below
    return out


def descend(key: Column, root: Node) -> Column:
    """The shard that a key reaches; a level's draws are taken among the chosen node's children alone."""
    at = F.lit(0)
    for table in levels(root):
        children = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(i).alias("at")) for n, w, i in row]) for row in table])
        bits = lambda c: F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), c["name"]).cast("binary")), 1, 13), 16, 10).cast("double")  # noqa: E731  52 bits
        draw = lambda c: F.struct((-F.log((bits(c) + 0.5) / float(1 << 52)) / c["weight"]).alias("draw"), c["at"].alias("at"))
        at = F.array_min(F.transform(F.element_at(children, at + 1), draw))["at"]
    return at


def shard_key(doc_id: str = "doc_id") -> Column:
    """Ids as text; a null id has a key of its own."""
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("\\N"))


def assign(docs: DataFrame, shards: int, doc_id: str = "doc_id", name: str = "shard", base: int = BASE_SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """Adds the shard of each row. Equal ids share a shard; nothing else of a row counts."""
    if not layout(shards, base, weights).children:
        raise ValueError("no shard has a weight")
    return docs.withColumn(name, descend(shard_key(doc_id), layout(shards, base, weights)).cast("int"))


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places documents (law `key`): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has 16 bytes and the crc32 of no bytes. Only these narrow
    columns are shuffled, never texts. Repeated rows get slots of their own.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(assign(narrow, shards), shards + 1, name="grown_shard")
    return ranked(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", rows=docs.count())
