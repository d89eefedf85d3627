"""Near copies by SimHash with multi-index hashing, and the exact similarity of shingle sets.

Two texts are linked where the Jaccard similarity of their sets of word shingles is at least a threshold; a group is all
that chains of links reach. Fingerprints of the sets that chains of at most ``radius`` differing bits connect
(``op10_simhash.links``) make the first candidate groups. Texts at similarity 0.8 differ in about an eighth of their
fingerprints' bits, give or take so many that any radius loses some; so exact filters look for links between texts of
different SimHash groups, and sets decide about all candidates:

1. Texts of equal sets are one node.
2. SimHash: the components of near fingerprints. Nodes of one need not be compared in steps 3 and 4.
3. Prefix filtering: in one order of all shingles, the leading ones of similar sets share a shingle. Shingles that are
   frequent in a sample stand last, by classes of frequency; that decides the cost and never the result.
4. Nodes that share a leading shingle are compared by bitmaps: a set's bitmap has, for each of 1024 buckets of hashes,
   the parity of its shingles in it (more for larger sets; larger bitmaps fold to smaller ones). They never differ in more bits than the sets differ in
   shingles, so no link is lost.
   Components of what SimHash and the bitmaps allow are candidate groups, and these are compared by their sets.
5. In both comparisons (``group_stars``) nodes that are connected already are not compared again, so a group of copies costs
   about one comparison a node. A group that one task can hold is searched there. A larger one is dealt out in blocks of
   bounded size, and all blocks are compared with ``heads`` of the nodes that are not of the group's largest component
   yet, until only that one has nodes that were no heads.

Empty sets (null texts, texts of no word) are equal. Where doc_ids are equal the lesser hash of the text stands first,
null doc_ids come last, and of rows of equal doc_id and text one stays. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechtab.llm.common import fresh, map_texts, materialize, partitions, release, remove
from speechtab.llm.graph import components
from speechtab.llm.op10_simhash import SEED, links, majority, shingle_hashes

#: One text in so many is looked at for frequent shingles; as many of those at most are told apart (by whole classes).
SAMPLE, MOST_FREQUENT = 32, 500_000
#: The bits of a shingle's hash in its place in the order; its class of frequency stands before them.
PLACE = 58


def bitmap(shingles: np.ndarray) -> bytes:
    """The parities of the numbers of shingles in as many buckets as the least power of two of 2 n and 1024 at least."""
    buckets = max(1024, 1 << (2 * len(shingles) - 1).bit_length() if len(shingles) else 0)
    bucket = (shingles & np.uint64(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=buckets) & 1).astype(np.uint8)).tobytes()


class Bitmaps:
    """Bitmaps of several sizes, by size; each can be folded to half its size, where it is the smaller size's bitmap."""

    def __init__(self, column: pd.Series, n: np.ndarray) -> None:
        raw, self.n = list(column), n
        self.bytes = np.array([len(x) for x in raw], dtype=np.int64)
        self.at, self.maps = np.zeros(len(raw), dtype=np.int64), {}
        for size in np.unique(self.bytes).tolist():
            rows = np.flatnonzero(self.bytes == size)
            self.at[rows] = np.arange(len(rows))
            self.maps[size] = np.frombuffer(b"".join(raw[i] for i in rows), dtype="<u8").reshape(len(rows), -1)

    def get(self, rows: np.ndarray, size: int, as_size: int) -> np.ndarray:
        """The bitmaps of ``rows``, all of ``size`` bytes, as ones of ``as_size`` bytes (the same or half)."""
        x = self.maps[size][self.at[rows]]
        half = x.shape[1] // 2
        return x if size == as_size else x[:, :half] ^ x[:, half:]

    def near(self, rows: np.ndarray, other: Bitmaps, with_: np.ndarray, least: float) -> np.ndarray:
        """Whether each of ``rows`` may be linked to its partner in ``with_`` (rows of ``other``)."""
        n, m = self.n[rows], other.n[with_]
        fit = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9
        for size in np.unique(self.bytes[rows[fit]]).tolist():
            for its in (size // 2, size, 2 * size):
                at = np.flatnonzero(fit & (self.bytes[rows] == size) & (other.bytes[with_] == its))
                if len(at):
                    small = min(size, its)
                    differ = np.bitwise_count(self.get(rows[at], size, small) ^ other.get(with_[at], its, small)).sum(axis=1)
                    fit[at] = differ <= most_different(n[at], m[at], least)
        return fit


def most_different(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """The most shingles that stand in one only of two sets of n and m shingles and similarity ``least``."""
    return (1 - least) / (1 + least) * (n + m) + 1e-9


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the similarity of two sorted arrays of distinct hashes is at least ``least``; empty ones are equal."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def prefix(shingles: np.ndarray, least: float, frequent: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The places of the first of ``shingles`` (distinct); ``frequent`` (sorted hashes) stand behind, by their class.

    Sets of similarity ``least`` share that part of either one's shingles at least, and so one of these.
    """
    place = shingles >> np.uint64(64 - PLACE)
    if len(frequent) and len(shingles):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        place |= np.where(frequent[at] == shingles, classes[at], 0).astype(np.uint64) << np.uint64(PLACE)
    place = np.sort(place)
    return place[: len(place) - math.ceil(least * len(place) - 1e-9) + 1].view(np.int64)


def run_pairs(keys: np.ndarray, node: np.ndarray, n: np.ndarray, sim: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (lesser, greater) of nodes that share a key, of other SimHash groups and of sizes that fit; ``keys`` are sorted."""
    left, out, d = np.arange(len(keys)), [(np.zeros(0, dtype=np.int64),) * 2], 1
    while len(left):
        left = left[left + d < len(keys)]
        left = left[keys[left + d] == keys[left]]
        fit = left[sim[left] != sim[left + d]]
        fit = fit[np.minimum(n[fit], n[fit + d]) >= least * np.maximum(n[fit], n[fit + d]) - 1e-9]
        out.append((node[fit], node[fit + d]))
        d += 1
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]


def meet(it: Iterator[pd.DataFrame], least: float, run_rows: int) -> Iterator[pd.DataFrame]:
    """u, v, long for batches (key, node, n, sim) sorted by key; holds at most ``run_rows`` rows besides a batch.

    Runs of at most ``run_rows`` rows give pairs (u, v); a longer one gives each of its rows, as (key, node).
    """
    none = np.zeros(0, dtype=np.int64)
    keys, node, n, sim, open_key = none, none, none, none, None
    for pdf in it:
        if not len(pdf):
            continue
        k, x, m, y = (pdf[c].to_numpy() for c in ("key", "node", "n", "sim"))
        keys, node, n, sim = np.r_[keys, k], np.r_[node, x], np.r_[n, m], np.r_[sim, y]
        cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[cut, len(keys)])
        long = np.repeat((size > run_rows) | (keys[cut] == open_key), size)
        done = ~long
        done[cut[-1] :] = False
        u, v = run_pairs(keys[done], node[done], n[done], sim[done], least)
        yield pd.DataFrame({"u": u, "v": v, "long": False}).drop_duplicates()
        yield pd.DataFrame({"u": keys[long], "v": node[long], "long": True})
        open_key = keys[-1] if long[-1] else None
        keep = slice(len(keys) if long[-1] else cut[-1], None)
        keys, node, n, sim = keys[keep], node[keep], n[keep], sim[keep]
    u, v = run_pairs(keys, node, n, sim, least)
    yield pd.DataFrame({"u": u, "v": v, "long": False})
    release()


class Sets:
    """Nodes with the component they are known to be of (any label of it), their bitmaps and, if there is a column ``sh``, their sets."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.node = pdf["node"].to_numpy()
        self.root = pdf["root"].to_numpy() if "root" in pdf else self.node
        self.maps = Bitmaps(pdf["bm"], pdf["n"].to_numpy())
        self.raw = list(pdf["sh"]) if "sh" in pdf else None

    def set(self, i: int) -> np.ndarray:
        return np.frombuffer(self.raw[i], dtype="<u8")


def links_between(rows: Sets, heads: Sets, least: float) -> pd.DataFrame:
    """Edges (u, v) that connect all components of rows and heads that a link of a row and a head does.

    Links are those of the sets; where there are none, those that the bitmaps allow.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    root, u, v = rows.root.copy(), [], []
    for j in range(len(heads.node)):
        own = find(int(heads.root[j]))
        other = np.flatnonzero(root != own)
        if rows is heads:
            other = other[other > j]
        if not len(other):
            continue
        near = rows.maps.near(other, heads.maps, np.full(len(other), j), least)
        for i in other[near].tolist():
            mine = find(int(root[i]))
            if mine != own and (rows.raw is None or similar(rows.set(i), heads.set(j), least)):
                u.append(rows.node[i])
                v.append(heads.node[j])
                parent[mine] = own
            root[i] = find(mine)
    return pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})


def linked(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Edges (u, v) that connect each node of a component of the links in one group to one of them.

    Where there is a column ``root``, nodes of one root are not compared: edges and equal roots together connect them.
    """
    rows = Sets(pdf)
    links = links_between(rows, rows, least)
    place = {x: i for i, x in enumerate(rows.node.tolist())}
    root = list(range(len(place)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for u, v in zip(links["u"].tolist(), links["v"].tolist(), strict=True):
        root[find(place[u])] = find(place[v])
    up = np.array([find(i) for i in range(len(root))], dtype=np.int64)
    own = up != np.arange(len(up))
    return pd.DataFrame({"u": rows.node[own], "v": rows.node[up[own]]})


def group_stars(members: DataFrame, least: float, group_rows: int, group_mb: int, heads: int) -> DataFrame:
    """Edges (u, v) that connect, in each group g of ``members`` (g, node, n, bm and maybe sh), what its links connect.

    Within a group, each node has at most one edge, to one node of its component. Groups of at most ``group_rows`` rows
    and ``group_mb`` MB are searched in one task each, others in blocks. Nodes of one ``root``, if there is that column,
    may be left to it.
    """
    own = F.length("sh") if "sh" in members.columns else F.length("bm")
    sizes = members.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / group_rows), F.ceil(F.sum(own) / F.lit(group_mb << 20))).cast("int").alias("blocks"))
    sizes = materialize(sizes, "sizes")
    some = members.join(sizes.where("blocks = 1").select("g"), "g")
    edges = some.groupBy("g").applyInPandas(lambda pdf: linked(pdf, least), "u long, v long")
    large = sizes.where("blocks > 1")
    return edges if large.isEmpty() else edges.union(_large_stars(members.drop("root").join(large, "g"), least, group_mb, heads))


def _large_stars(large: DataFrame, least: float, group_mb: int, heads: int) -> DataFrame:
    """The edges of ``group_stars`` for groups ``large`` (g, blocks, node, n, bm and maybe sh)."""
    spark = large.sparkSession
    large = materialize(large, "large")
    columns = [c for c in large.columns if c not in ("g", "blocks", "node")]
    own = F.length("sh") if "sh" in columns else F.length("bm")
    state = materialize(large.select("g", "node", own.alias("bytes"), F.col("node").alias("root"), F.lit(False).alias("done")), "state")
    edges, most = spark.createDataFrame([], "u long, v long"), min(heads, 64)
    while True:
        open_ = state.where("not done").groupBy("g", "root").count()
        largest = open_.groupBy("g").agg(F.max(F.struct("count", "root"))["root"].alias("largest"))
        w = Window.partitionBy("g").orderBy("node")
        left = state.where("not done").join(largest, "g").where("root <> largest")
        left = left.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
        left = left.withColumn("b", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        taken = materialize(left.where((F.col("r") == 1) | (F.col("b") <= group_mb << 20)).select("g", "node", "root"), "heads")
        most = heads
        if taken.isEmpty():
            remove(large, taken)
            return state.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        names = ["g", "b", "node", "root", *columns]
        rest = large.join(state.select("g", "node", "root"), ["g", "node"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        front = large.join(taken, ["g", "node"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def compare(rows: pd.DataFrame, front: pd.DataFrame) -> pd.DataFrame:
            return links_between(Sets(rows), Sets(front), least) if len(rows) and len(front) else pd.DataFrame({"u": [], "v": []}, dtype="int64")

        cells = [x.select(*names).toDF(*names).groupBy("g", "b") for x in (rest, front)]
        new = materialize(cells[0].cogroup(cells[1]).applyInPandas(compare, "u long, v long"), "near")
        edges = edges.union(new)
        roots = components(edges).withColumnRenamed("root", "new")
        step = state.join(roots, "node", "left").join(taken.select("g", "node", F.lit(True).alias("taken")), ["g", "node"], "left")
        done = F.col("done") | F.coalesce("taken", F.lit(False))
        step = materialize(step.select("g", "node", "bytes", F.coalesce("new", "root").alias("root"), done.alias("done")), "state")
        remove(state, taken, roots)
        state = step


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and classes of shingles that stand in several texts of a sample; they only set the order."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for t in pdf["text"]:
                yield pd.DataFrame({"s": np.unique(shingle_hashes(t, shingle)).view(np.int64)})

    some = rows.where(F.pmod("h", F.lit(SAMPLE)) == 0).dropDuplicates(["h"]).select("text").mapInPandas(batches, "s long")
    many = some.groupBy("s").count().where("count > 1").select("s", F.floor(F.log2("count")).cast("int").alias("c"))
    many = materialize(many, "frequent")
    sizes = sorted(((r["c"], r["count"]) for r in many.groupBy("c").count().collect()), reverse=True)
    least = next((c + 1 for i, (c, _) in enumerate(sizes) if sum(k for _, k in sizes[: i + 1]) > MOST_FREQUENT), 0)
    got = many.where(F.col("c") >= least).toPandas()
    remove(many)
    h = got["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.minimum(got["c"].to_numpy(np.int64)[order], 31)


def drop_near_copies(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, group_rows: int = 256, group_mb: int = 8, heads: int = 1024, run_rows: int = 32, run_block: int = 2048,
    radius: int = 4, segments: int = 2,
) -> DataFrame:
    """``docs`` (doc_id, text and any columns) without near copies: of each group the document of least doc_id stays.

    ``shingle`` and ``similarity`` define the links. The others are bounds of what one task holds, and don't change the
    result: runs of more than ``run_block`` nodes, and candidate groups of more than ``group_rows`` sets or ``group_mb`` MB,
    are dealt out; ``radius`` and ``segments`` are SimHash's, and what it doesn't reach the exact filters do.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    sent = spark.sparkContext.broadcast(_frequent(rows, shingle))

    def prints(texts: list[str | None]) -> list[pa.Array]:
        sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
        own = [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]
        fps = pa.array(np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64))
        p = [prefix(s, similarity, *sent.value) for s in sets]
        places = pa.ListArray.from_arrays(np.cumsum([0, *map(len, p)], dtype=np.int32), pa.array(np.concatenate(p) if p else [], pa.int64()))
        return [pa.array(own, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), places, fps]

    got = materialize(map_texts(rows, ["no_id", "doc_id", "h"], prints, "own binary, n long, bm binary, p array<long>, fp long"), "prints")
    near_fps = components(links(got.select("fp").distinct(), radius, segments)).toDF("fp", "root")
    # A node is a distinct set; its first row stands for it. The numbers are unique, and fixed once written.
    nodes = got.groupBy("own").agg(F.min(F.struct("no_id", "doc_id", "h")).alias("f"), *[F.first(c).alias(c) for c in ("n", "bm", "p", "fp")])
    nodes = nodes.join(near_fps, "fp", "left").withColumn("sim", F.coalesce("root", "fp"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "f", "n", "bm", "p", "sim"), "nodes")
    least = nodes.groupBy("sim").agg(F.min("node").alias("v"), F.count("*").alias("k")).where("k > 1")
    alike = nodes.select(F.col("node").alias("u"), "sim").join(least, "sim").where("u <> v").select("u", "v")

    late = F.lit(1 << PLACE)
    cold = nodes.select(F.explode(F.filter("p", lambda x: x < late)).alias("key"), "node", "n", "sim")
    cold = cold.repartition(partitions(spark), "key").sortWithinPartitions("key")
    met = materialize(cold.mapInPandas(lambda it: meet(it, similarity, run_rows), "u long, v long, long boolean"), "met")

    def may_link(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                u, v = (Bitmaps(pdf[f"bm{x}"], pdf[f"n{x}"].to_numpy()) for x in "uv")
                every = np.arange(len(pdf))
                yield pdf[["u", "v"]][u.near(every, v, every, similarity)]

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bm").alias(f"bm{x}"))
    close = met.where("not long").select("u", "v").distinct().join(side("u"), "u").join(side("v"), "v").mapInPandas(may_link, "u long, v long")
    hot = nodes.select(F.explode(F.filter("p", lambda x: x >= late)).alias("g"), "node")
    long = hot.union(met.where("long").select(F.col("u").alias("g"), F.col("v").alias("node")))
    met_twice = long.groupBy("g").count().where("count > 1").select("g")
    runs = materialize(long.join(met_twice, "g").join(nodes.select("node", "n", "bm", F.col("sim").alias("root")), "node"), "runs")
    near = components(alike.union(close).union(group_stars(runs, similarity, run_block, group_mb, heads))).withColumnRenamed("root", "g")
    member = materialize(near.join(nodes.select("node", "f.no_id", "f.doc_id", "f.h"), "node"), "members")

    def sets(texts: list[str | None]) -> list[pa.Array]:
        found = [np.unique(shingle_hashes(t, shingle)) for t in texts]
        return [pa.array([len(s) for s in found], pa.int64()), pa.array([bitmap(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]

    full = map_texts(rows.join(member, ["no_id", "doc_id", "h"]), ["g", "node"], sets, "n long, bm binary, sh binary", 64)
    full = materialize(full.dropDuplicates(["node"]), "sets")  # repeated rows
    # Every node is in one group, so these edges name its component; no step over the graph is needed.
    roots = group_stars(full, similarity, group_rows, group_mb, heads).toDF("node", "root")
    named = nodes.select("node", "f").join(roots, "node", "left")
    kept = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("f").alias("f"))
    names = [fresh(f"kept_{c}", docs) for c in ("no_id", "doc_id", "h")]
    kept = materialize(kept.select(*[F.col(f"f.{c}").alias(x) for c, x in zip(("no_id", "doc_id", "h"), names, strict=True)]), "kept")
    twice = not got.groupBy("no_id", "doc_id", "h").count().where("count > 1").isEmpty()
    remove(got, nodes, met, runs, member, full)
    same = (F.col("doc_id").isNull() == F.col(names[0])) & (F.coalesce("doc_id", F.lit(0)) == F.col(names[1])) & (F.xxhash64(text) == F.col(names[2]))
    out = docs.join(kept, same)
    out = out.dropDuplicates(names) if twice else out
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
