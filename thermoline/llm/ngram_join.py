"""N-gram Jaccard self-join by a MinHash LSH forest.

Texts are sets of five-word shingles. Equal sets are one class from the start, so copies are
never compared. Each distinct set has a label of minhashes in every tree of the forest; a
prefix of a label is a node of the tree, and sets below one node are candidates. The search
begins at whole labels and shortens the prefixes a level at a time, each level taking only
pairs that met at no deeper one. Every verified link has a similarity, and with it a known
chance of meeting at this depth, so the links found so far say how many there are (each
counts as one over its chance): the descent ends when the recall so measured reaches the
target, and at the latest where a pair at the very threshold reaches it. The trie is kept as
its nodes, counted by prefix, not as a sorted array: sorting would put all sets below one
frequent prefix into one task, where counts are summed before they are shuffled.

Candidates are verified exactly, by their shingles. A node whose pairs all meet in an
earlier tree is left out, and a pair counts in the first tree where it meets, so none
counts twice. A large node is cut into blocks, and each pair of blocks is one piece of
work: pairs are counted inside a task by a matrix product and never become rows; a block
yields a row for each set with its number of links and one member that it hangs together
with. Classes are the connected components of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermoline.llm import textkit as tk
from thermoline.llm.workspace import stored

WORDS, THRESHOLD = 5, 0.8
TREES, LABEL, TARGET_RECALL = 16, 6, 0.995
#: Most shingles and sets of a block.
BLOCK_SHINGLES, BLOCK_SETS = 200_000, 200
#: Fewest links that a recall is measured on.
LEAST_LINKS = 100

_U = np.uint64
_draws = np.random.default_rng(77).integers(1, 2**63, (2, TREES * LABEL), dtype=np.uint64)
_TIMES, _PLUS = _draws[0] * _U(2) + _U(1), _draws[1]


def depth(threshold: float = THRESHOLD, trees: int = TREES, label: int = LABEL, target: float = TARGET_RECALL) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree often enough: no level below it is needed."""
    for d in range(label, 1, -1):
        if chance(threshold, d, trees) >= target:
            return d
    return 1


def chance(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """That a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shingles(column: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their offsets; a text with fewer words is one shingle, one without words none."""
    data, off = tk.utf8(column)
    w = tk.Words(data, off)
    h = w.hashes()
    key, inside = tk.window_hash(h, w.doc, n)
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    first = np.searchsorted(w.doc, short)
    whole = np.array([tk.mix(np.array([sum(int(x) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, x in enumerate(h[s : s + c])) & (2**64 - 1)], _U) + _U(c))[0] for s, c in zip(first, w.count[short], strict=True)], _U)
    key, doc = np.concatenate([key[inside], whole]), np.concatenate([w.doc[: len(inside)][inside], short])
    order = np.argsort(key)
    order = order[np.argsort(doc[order].astype(np.uint16) if w.docs < 1 << 16 else doc[order], kind="stable")]
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(w.docs + 1))


def _set_ids(key: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """A 16-byte name of each set, null for an empty one."""
    halves = []
    for salt in (0x51, 0xA7):
        sums = np.zeros(len(key) + 1, _U)
        np.cumsum(tk.mix(key + _U(salt)), out=sums[1:])
        halves.append(tk.mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(_U)))
    raw = np.stack(halves, axis=1).tobytes()
    return [raw[16 * k : 16 * k + 16] if off[k + 1] > off[k] else None for k in range(len(off) - 1)]


def _labels(key: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The labels of all trees, one after another, 4 big-endian bytes for each minhash, so that bytes sort as labels do."""
    docs = len(off) - 1
    full = np.flatnonzero(off[1:] > off[:-1])
    out = np.full((docs, TREES * LABEL), 0xFFFFFFFF, ">u4")
    if len(full):
        for k in range(TREES * LABEL):
            out[full, k] = np.minimum.reduceat((key * _TIMES[k] + _PLUS[k]) >> _U(32), off[:-1][full])
    raw = out.tobytes()
    return [raw[4 * TREES * LABEL * k : 4 * TREES * LABEL * (k + 1)] for k in range(docs)]


def _row_key(docs: DataFrame, columns: list[str]) -> F.Column:
    """128 bits of these columns; maps by their sorted entries."""
    kinds = dict(docs.dtypes)
    named = [F.array_sort(F.map_entries(F.col(f"`{c}`"))) if kinds[c].startswith("map<") else F.col(f"`{c}`") for c in columns]
    told = [x for c in named for x in (c.isNull(), c)]  # nulls are passed over by the hash
    return F.struct(F.xxhash64(*told).alias("a"), F.xxhash64(F.lit("thermoline"), *told).alias("b"))


_ROW_KEY = "struct<a:long,b:long>"


def _signed(rows: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                key, off = shingles(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rkey"), pa.array(_set_ids(key, off), pa.binary()), pa.array(np.diff(off)), pa.array(_labels(key, off), pa.binary())], ["doc_id", "rkey", "set_id", "size", "labels"])

    return rows.mapInArrow(sign, f"doc_id long, rkey {_ROW_KEY}, set_id binary, size long, labels binary")


def _places(bits: int) -> list[F.Column]:
    """The bits of a row key in a filter of so many bits."""
    return [F.pmod(F.xxhash64("rkey", F.lit(k)), F.lit(bits)) for k in range(2)]


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of row keys, made by Spark word by word: 16 to 32 bits a key, 8 MB at most.

    Beyond that it lets more through, which the exact join after it drops.
    """
    bits = 1 << min(26, max(16, (16 * keys.count()).bit_length()))
    each = keys.select(F.explode(F.array(*_places(bits))).alias("place"))
    words = each.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("value")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["value"].to_numpy()
    return out.view(_U)


def _shingled(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """Sets and shingles of the needed rows, found in a scan: texts stay where they are, only shingles are shuffled."""
    spark = rows.sparkSession
    bloom = spark.sparkContext.broadcast(_filter(needed))
    first, second = _places(64 * len(bloom.value))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.ones(batch.num_rows, bool)
            for c in ("first", "second"):
                place = batch.column(c).to_numpy()
                wanted &= (bloom.value[place >> 6] >> (place & 63).astype(_U) & _U(1)) == 1
            for part in tk.slices(batch.select(["rkey", "text"]).filter(pa.array(wanted)), "text"):
                key, off = shingles(part.column("text"))
                lists = pa.ListArray.from_arrays(off.astype(np.int32), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("rkey"), pa.array(_set_ids(key, off), pa.binary()), lists], ["rkey", "set_id", "shingles"])

    found = rows.select("rkey", "text", first.alias("first"), second.alias("second")).mapInArrow(cut, f"rkey {_ROW_KEY}, set_id binary, shingles array<long>")
    return found.join(needed, ["set_id", "rkey"]).drop("rkey")


def _similar(sets: list[np.ndarray], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """The Jaccard similarity of the wanted pairs of sets where it is the threshold or more, else 0."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        shared = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if min(size) >= threshold * max(size) - 1e-9 else 0
        both = np.full((2, 2), float(shared))
    else:
        owner = np.repeat(np.arange(n), size)
        _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.cumsum(count > 1) - 1
        shared = count[at] > 1
        owner, column = owner[shared], rank[at[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((n, n), np.float32)
        width = max(64, min(4096, 2_000_000 // n))
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            s, e = np.searchsorted(column, [c, c + width])
            cells = np.zeros((n, width), np.float32)
            cells[owner[s:e], column[s:e] - c] = 1
            both += cells @ cells.T
        both = both.astype(float)  # whole numbers below 2**24 each, so the products are exact
    union = size[:, None] + size[None, :] - both
    return np.where(wanted & (both >= threshold * union - 1e-9), both / np.maximum(union, 1), 0.0)


def _together(linked: np.ndarray) -> np.ndarray:
    """For each set the least member of its component."""
    name = np.arange(len(linked))
    while True:
        best = np.minimum(name, np.where(linked, name[None, :], len(linked)).min(axis=1))
        best = best[best]
        if (best == name).all():
            return name
        name = best


_TASK = ["tree", "node", "i", "j"]


def _verified(work: DataFrame, threshold: float, target_depth: int, depth: int) -> DataFrame:
    """Rows of (set, links, head, and for each depth from the target's on, the links each by one over its chance) from work that is sorted by task."""

    def judge(task: tuple, rows: list[tuple]) -> list[tuple]:
        tree, _, i, j = task
        rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0])  # of repeated rows one
        if len(rows) < 2:
            return []
        keys, deeper = np.stack([r[3] for r in rows]), np.stack([r[4] for r in rows])
        wanted = ~np.eye(len(rows), dtype=bool)
        for t in range(tree):
            wanted &= keys[:, None, t] != keys[None, :, t]
        for t in range(deeper.shape[1]):
            wanted &= deeper[:, None, t] != deeper[None, :, t]
        if i != j:
            block = np.array([r[1] for r in rows])
            wanted &= block[:, None] != block[None, :]
        if not wanted.any():
            return []
        similar = _similar([r[5] for r in rows], wanted, threshold)
        some = np.flatnonzero(similar.any(axis=1))
        if not len(some):
            return []
        similar = similar[np.ix_(some, some)]
        linked = similar > 0
        copies, head = np.array([rows[k][2] for k in some]), _together(linked)
        links = linked @ copies
        hidden = [np.where(linked, 1 / chance(np.where(linked, similar, 1.0), d), 0.0).sum(axis=1) for d in range(target_depth, LABEL + 1)]
        return [(rows[k][0], int(links[x]), rows[some[head[x]]][0], int(linked[x].sum()), [float(h[x]) for h in hidden]) for x, k in enumerate(some)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, bytes]] = []
        task, rows = None, []
        for batch in batches:
            names = [list(x) for x in zip(*(batch.column(c).to_pylist() for c in _TASK), strict=True)]
            ids, block, copies = (batch.column(c).to_pylist() for c in ("set_id", "block", "copies"))
            flat = {}
            for c in ("nodes", "deeper", "shingles"):
                lists = batch.column(c)
                flat[c] = (lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]))
            for k, name in enumerate(names):
                if name != task:
                    if task:
                        out += judge(tuple(task), rows)
                    task, rows = name, []
                cut = {c: x[int(o[k]) : int(o[k + 1])].copy() for c, (x, o) in flat.items()}
                rows.append((ids[k], block[k], copies[k], cut["nodes"], cut["deeper"], cut["shingles"]))
            if len(out) >= 5000:
                yield _links(out)
                out = []
        if task:
            out += judge(tuple(task), rows)
        yield _links(out)

    def _links(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.int64()), pa.array([r[4] for r in out], pa.list_(pa.float64()))], ["set_id", "links", "head", "n", "hidden"])

    return work.mapInArrow(walk, "set_id binary, links long, head binary, n long, hidden array<double>")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges, a component being its least node.

    Labels spread along edges and jump to their labels' labels; each round is a written table.
    """
    edges = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    both = edges.union(edges.select("b", "a"))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        now = stored(spread.join(jump, "label").select("node", F.least("label", "far").alias("label"), "old"), "labels")
        labels = now.select("node", "label")
        if now.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _prefixes(depth: int) -> F.Column:
    """The node of this depth in each tree; none below whole labels."""
    return F.array(*(F.xxhash64(F.lit(t), F.substring("labels", 4 * LABEL * t + 1, 4 * depth)) for t in range(TREES))) if depth <= LABEL else F.array().cast("array<long>")


def _crowded(sets: DataFrame, depth: int) -> DataFrame:
    """Tree, node, number and shingles of each node with several sets; stored, so that joins by node have no aggregate at their side and Spark can split a large node."""
    below = sets.select("size", F.posexplode(_prefixes(depth)).alias("tree", "node"))
    return stored(below.groupBy("tree", "node").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1"), "crowded")


def _level(sets: DataFrame, payload: DataFrame, depth: int, last: int, threshold: float) -> DataFrame:
    """The links of pairs that meet at this depth and at no deeper one."""
    nodes = sets.select("set_id", _prefixes(depth).alias("nodes"), _prefixes(depth + 1).alias("deeper"))
    member = nodes.select("set_id", F.posexplode("nodes").alias("tree", "node")).join(_crowded(sets, depth).hint("merge"), ["tree", "node"]).join(nodes, "set_id")
    member = stored(member, "members")
    met = F.lit(False) if depth == LABEL else F.min(F.get("deeper", F.col("tree"))) == F.max(F.get("deeper", F.col("tree")))
    for t in range(TREES - 1):
        met = met | ((F.col("tree") > t) & (F.min(F.get("nodes", F.lit(t))) == F.max(F.get("nodes", F.lit(t)))))
    fresh = member.groupBy("tree", "node").agg(met.alias("met")).where(~F.col("met")).select("tree", "node")
    fresh = stored(fresh, "fresh")
    blocks = F.greatest(F.ceil(F.col("weight") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_SETS)).cast("int")
    work = member.join(fresh.hint("merge"), ["tree", "node"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_id", F.lit("block")), "blocks").cast("int"))
    work = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = stored(work.select("tree", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set_id", "block", "nodes", "deeper"), "work")
    work = work.join(payload, "set_id").repartition(*_TASK).sortWithinPartitions(*_TASK, "set_id")
    return stored(_verified(work, threshold, last, depth), "links")


def _classes(docs: DataFrame, threshold: float, target: float, id_col: str, text_col: str, columns: list[str]) -> tuple[DataFrame, DataFrame, list[tuple[int, int, float]]]:
    """The signed rows; for each set its copies, links, and the first row of its class; and depth, links so far and recall of each level."""
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row_key(docs, columns).alias("rkey"), text.alias("text"))
    signed = stored(_signed(source), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rkey")
    sets = signed.where("set_id IS NOT NULL").groupBy("set_id").agg(F.count("*").alias("copies"), F.min(first).alias("first"), F.first("size").alias("size"), F.first("labels").alias("labels"))
    sets = stored(sets, "sets")

    last = depth(threshold, TREES, LABEL, target)
    some = sets.select("set_id", F.posexplode(_prefixes(last)).alias("tree", "node")).join(_crowded(sets, last).hint("merge"), ["tree", "node"]).select("set_id").distinct()
    some = stored(some.join(sets.select("set_id", "copies", "size", "labels", F.col("first.rkey").alias("rkey")), "set_id"), "some")
    payload = stored(_shingled(source, some.select("set_id", "copies", "rkey")), "shingles")

    levels, found, links = [], 0, None
    seen = np.zeros(LABEL + 1 - last)
    for d in range(LABEL, last - 1, -1):
        new = _level(some, payload, d, last, threshold)
        sums = new.agg(F.sum("n").alias("n"), *(F.sum(F.get("hidden", F.lit(k))).alias(f"d{k}") for k in range(len(seen)))).first()
        found += sums["n"] or 0
        seen += [sums[f"d{k}"] or 0.0 for k in range(len(seen))]
        links = new if links is None else links.union(new)
        recall = found / seen[d - last] if found else 0.0
        levels.append((d, found // 2, recall))
        if recall >= target and found >= 2 * LEAST_LINKS:
            break

    classes = components(links.select("set_id", "head"), "set_id", "head")
    named = classes.withColumnRenamed("node", "set_id").join(sets.select("set_id", "first"), "set_id")
    heads = named.groupBy("component").agg(F.min("first").alias("class_first"))
    named = named.join(heads, "component").select("set_id", "class_first")
    count = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    known = sets.select("set_id", "copies", "first").join(named, "set_id", "left").join(count, "set_id", "left")
    return signed, known.select("set_id", F.coalesce("class_first", "first").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), levels


def measured_recall(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, float]]:
    """Of each level of the descent: its depth, the links of different sets found up to it and the recall that they imply."""
    return _classes(docs, threshold, target, id_col, text_col, [id_col, text_col])[2]


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: the least id of its class and its number of links.

    Links are the other rows with an equal shingle set or one of at least the threshold.
    Null and empty texts and others without words link to nothing and are classes of their
    own; a text of fewer than five words is one shingle. Null ids come after all others;
    repeated rows are copies of one another; of rows that share a least id, the class has that
    id. An empty table gives no rows; other columns, whatever their names, aren't looked at.
    A long text is a slice of its own, with 8 bytes for each of its shingles; a large group of
    copies is one set, and one of near copies is compared in blocks.
    """
    signed, known, _ = _classes(docs, threshold, target, id_col, text_col, [id_col, text_col])
    known = stored(known, "known")  # as above: a large group of copies can be split
    rows = signed.where("set_id IS NOT NULL").select("doc_id", "set_id").join(known.hint("merge"), "set_id", "left")
    rows = rows.select("doc_id", F.col("head.doc_id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"))
    return rows.union(signed.where("set_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that come first in their class; of rows alike in all columns one.

    First is the least id, null ids last, then a hash of all columns. Rows without words all
    stay, but for repeated ones; an empty table stays empty; long texts as above.
    """
    signed, known, _ = _classes(docs, threshold, target, id_col, text_col, docs.columns)
    alone = signed.where("set_id IS NULL").select("rkey")
    key = next(name for name in (f"row_key_{n}" for n in range(len(docs.columns) + 1)) if name not in {c.lower() for c in docs.columns})
    kept = known.select(F.col("head.rkey").alias("rkey")).union(alone).distinct().withColumnRenamed("rkey", key)
    rows = docs.withColumn(key, _row_key(docs, docs.columns)).join(kept.hint("merge"), key, "left_semi")
    if not signed.groupBy("rkey").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates([key])
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))
