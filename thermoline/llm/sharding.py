"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards, and each node's weight is the sum of its shards'.
A row draws -ln(u) / weight at every child of a node, u being a hash of its key and the
child's label, and descends to the least draw: at each level the odds are the weights.

The tree grows by epochs. Shards that are added later leave all earlier draws as they are:
their epoch is a tree of its own with just the added weights, whose regions draw beside the
older ones; a row for which such a draw is the least descends the epoch's racks and shards.
So a row moves only into subtrees whose weight grew and there only into shards that were
added, and the odds are those of the grown weights, since the least of two exponential draws
is one with the sum.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermoline.llm.workspace import stored

#: Rows of one numbering group: large enough to keep the table of offsets small.
ROWS_PER_GROUP = 50_000


@dataclass(frozen=True)
class HashTree:
    """`regions[r][k]` are the weights of rack k's shards, numbered in order; `added` are later epochs of (region, rack, weight)."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]
    added: tuple[tuple[tuple[int, int, float], ...], ...] = field(default=())

    @classmethod
    def even(cls, shards: int, base: int = 8) -> HashTree:
        """Two racks of two shards in each of two regions; shards from number `base` on are added in turn to the racks."""
        return cls.sized((1.0,), shards, base)

    @classmethod
    def sized(cls, weights: tuple[float, ...], shards: int, base: int = 8) -> HashTree:
        """As `even`, but the shards' weights are these, over and over."""
        if shards < base or base % 4:
            raise ValueError(f"the tree begins with {base} shards, a multiple of 4")
        each = [weights[n % len(weights)] for n in range(shards)]
        racks = [tuple(each[k * base // 4 : (k + 1) * base // 4]) for k in range(4)]
        return cls(((racks[0], racks[1]), (racks[2], racks[3])), tuple(((n % 2, n // 2 % 2, each[base + n]),) for n in range(shards - base)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region) + sum(map(len, self.added))

    def shard(self, key: Column) -> Column:
        """The shard of each key."""

        def least(draws: list[tuple[str, float, Column]]) -> Column:
            if len(draws) == 1:
                return draws[0][2]
            best = F.least(*(draw(x, w) for x, w, _ in draws))
            out = draws[-1][2]
            for x, w, child in reversed(draws[:-1]):
                out = F.when(draw(x, w) == best, child).otherwise(out)
            return out

        def draw(label: str, weight: float) -> Column:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(label)), 11).cast("double") + 0.5) / float(2**53)
            return -F.log(u) / F.lit(float(weight))

        first, roots = 0, []
        for r, region in enumerate(self.regions):
            racks = []
            for k, rack in enumerate(region):
                leaves = [(f"{r}/{k}/{first + n}", w, F.lit(first + n)) for n, w in enumerate(rack)]
                first += len(rack)
                racks.append((f"{r}/{k}", sum(rack), least(leaves)))
            roots.append((f"{r}", sum(map(sum, region)), least(racks)))
        for epoch, shards in enumerate(self.added):
            named = [(r, k, (f"{r}/{k}/{first + n}", w, F.lit(first + n))) for n, (r, k, w) in enumerate(shards)]
            first += len(shards)
            for r in sorted({r for r, _, _ in named}):
                below = {k: [x for r2, k2, x in named if (r2, k2) == (r, k)] for k in sorted({k for r2, k, _ in named if r2 == r})}
                racks = [(f"{r}/{k}+{epoch}", sum(w for _, w, _ in leaves), least(leaves)) for k, leaves in below.items()]
                roots.append((f"{r}+{epoch}", sum(w for _, w, _ in racks), least(racks)))
        return least(roots).cast("int")


def sharded(docs: DataFrame, tree: HashTree, grown: HashTree, id_col: str = "doc_id", text_col: str = "text", rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """One row for each row of `docs`: its shard, its slot there and its shard in the grown tree.

    Slots run from 0 without gaps in each shard. A null text has size 1 and the checksum of
    no bytes; null ids share one key, and so does a repeated id: the law wants them in one
    shard, though not in one task. Repeated rows get slots of their own, in any order, as
    they are alike; an empty table gives no rows; long texts and other columns don't matter.
    Only ids, sizes and checksums are shuffled. Rows are numbered inside groups of a shard,
    by a hash of id and text and, so that equal rows spread too, the part they were read in;
    the groups' offsets are a small table, joined, not collected.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), tree.shard(key).alias("shard"), grown.shard(key).alias("grown_shard"), F.xxhash64(F.lit("slot"), key, F.crc32(text), F.monotonically_increasing_id()).alias("part"))
    rows = stored(rows, "rows")  # small: no texts; read twice below
    groups = max(1, -(-rows.count() // (rows_per_group * tree.shards)))
    rows = rows.withColumn("part", F.pmod("part", F.lit(groups)))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.selectExpr("shard", "part", "sum(n) OVER (PARTITION BY shard ORDER BY part) - n AS first")
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY shard, part ORDER BY doc_id, text_crc32, size) - 1 AS at")
    return numbered.join(starts, ["shard", "part"]).selectExpr("doc_id", "size", "text_crc32", "'key' AS law", "shard", "cast(first + at AS long) AS slot", "grown_shard")
