"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Vectors of equal components are grouped first (only the smallest ids of a
group can rank), lengthened by one component so that the largest inner product
becomes the smallest Euclidean distance, and dealt to the leaves of a tree of
k-means centres fitted on a bounded sample.  A leaf that still holds many rows
gets a tree of its own, fitted in a task on a bounded sample of the leaf, so
that the bins at the bottom keep their size however large the table is.  A
query walks the upper tree through a priority queue, nearest centre first, then
the lower trees of the leaves it reached, and visits as many of the nearest
bins as a calibration against brute force over all rows asked for.  Bins are
joined with their visitors in chunks of bounded size.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.session import materialize, release

#: Rows that the upper tree and each lower tree are fitted on (about; at most twice as many for the upper one).
SAMPLE_ROWS, LOWER_ROWS = 20_000, 8_192
#: Children of a node, rows of a bin (about), and the fewest rows of a sample that make a leaf.
BRANCH, LEAF_ROWS, LEAST_ROWS = 8, 1_024, 16
ROUNDS = 8
CHUNK_ROWS = 4_096
#: Calibration: so many queries, this recall, and leaf visits that widen by this factor.
CALIBRATION_QUERIES, RECALL, WIDEN = 64, 0.97, 1.6


@dataclass
class Tree:
    """Centres by node; children of a node are consecutive; leaves have none."""

    centres: np.ndarray
    children: list[tuple[int, int]]
    leaf: list[int]
    longest: float

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each lengthened vector, down the nearest centres."""
        out = np.empty(len(vectors), np.int64)
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            first, last = self.children[node]
            if first == last:
                out[rows] = self.leaf[node]
                continue
            nearest = _nearest(vectors[rows], self.centres[first:last])
            waiting += [(first + k, rows[nearest == k]) for k in range(last - first) if (nearest == k).any()]
        return out

    def visit(self, query: np.ndarray, visits: int, members: np.ndarray | None = None, least: int = 0) -> list[tuple[int, float]]:
        """Leaves and their distances, best bin first: so many, and more until they hold ``least`` members."""
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < visits or held < least):
            distance, node = heapq.heappop(queue)
            first, last = self.children[node]
            if first == last:
                found.append((self.leaf[node], distance))
                held += int(members[self.leaf[node]]) if members is not None else least
                continue
            away = ((self.centres[first:last] - query) ** 2).sum(axis=1)
            for k, distance in enumerate(away):
                heapq.heappush(queue, (float(distance), first + k))
        return found


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (-2 * vectors @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1)


def _kmeans(vectors: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        counts = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return np.unique(centres, axis=0)


def lengthen(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Add the component that makes all vectors equally long."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (vectors**2).sum(axis=1)))
    return np.c_[vectors, rest]


def grow(sample: np.ndarray, longest: float, leaf_rows: int) -> Tree:
    """Split the sample by k-means until leaves are small."""
    rng = np.random.default_rng(7)
    vectors = lengthen(sample, longest)
    centres, children, leaf = [np.zeros(vectors.shape[1])], [(0, 0)], [-1]
    waiting, leaves = [(0, vectors)], 0
    while waiting:
        node, rows = waiting.pop(0)
        split = _kmeans(rows, BRANCH, rng) if len(rows) > leaf_rows else np.empty((0, 0))
        if len(split) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        children[node] = (len(centres), len(centres) + len(split))
        own = _nearest(rows, split)
        for k, centre in enumerate(split):
            waiting.append((len(centres), rows[own == k]))
            centres.append(centre)
            children.append((0, 0))
            leaf.append(-1)
    return Tree(np.array(centres), children, leaf, longest)


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values])


def sound(rows: DataFrame, dimension: int | None = None) -> DataFrame:
    """Rows whose vector is neither null nor zero and has no null or non-finite component."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    value = F.transform("embedding", lambda x: x.cast("double"))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.forall("vector", good) & F.exists("vector", lambda x: x != 0.0)
    )
    return kept if dimension is None else kept.where(F.size("vector") == dimension)


def _top(k: int):
    """The best candidates of each asking vector among one chunk of a leaf: product, then smaller id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, asking = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        none = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("asked", "int64"), ("vec_id", "int64"), ("score", "float64"))})
        if members.empty or asking.empty:
            return none
        base, ids, out = _matrix(members["vector"]), members["ids"].to_numpy(), []
        for start in range(0, len(asking), 512):
            part = asking.iloc[start : start + 512]
            products = _matrix(part["vector"]) @ base.T
            n = min(len(base), k)
            cut = -np.partition(-products, n - 1, axis=1)[:, n - 1]
            for row, asked, least in zip(products, part["asked"], cut):
                pairs = [(-row[j], i) for j in np.flatnonzero(row >= least) for i in ids[j]]
                out += [(asked, i, -s) for s, i in heapq.nsmallest(k, pairs)]
        return pd.DataFrame(out, columns=["asked", "vec_id", "score"]).astype({"asked": "int64", "vec_id": "int64"})

    return run


def _brute(queries: np.ndarray, k: int):
    """Each part's best candidates of every calibration query, with the bin they lie in."""

    def run(batches):
        best: list[list] = [[] for _ in queries]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            leaf, bin_ = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            products = queries @ vectors.T
            for at, row in enumerate(products):
                near = np.argsort(-row, kind="stable")[:k]
                best[at] = heapq.nlargest(k, best[at] + [(float(row[j]), int(leaf[j]), int(bin_[j])) for j in near])
        rows = [(at, *found) for at, all_found in enumerate(best) for found in all_found]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["query", "score", "leaf", "bin"])

    return run


def _deal(tree: Tree):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                leaf = tree.place(lengthen(vectors, tree.longest))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(leaf)], ["vector", "ids", "leaf"])

    return run


def _grow_lower(longest: float, leaf_rows: int):
    """The tree of one leaf from its sample; a bin's share of the sample is that of its rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = _matrix(pdf["vector"])
        least = max(LEAST_ROWS, math.ceil(leaf_rows * len(sample) / int(pdf["n_leaf"].iloc[0])))
        # Rows come in the order of the shuffle; a fixed order makes a repeated task grow the same tree.
        sample = sample[np.lexsort(sample.T[::-1])]
        return pd.DataFrame({"leaf": [int(pdf["leaf"].iloc[0])], "tree": [pickle.dumps(grow(sample, longest, least))]})

    return run


def _bins_of(members: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    """The bins of one chunk of a leaf's members."""
    out = members[["vector", "ids", "leaf"]]
    if out.empty:
        return out.assign(bin=pd.Series(dtype="int64"))
    tree = pickle.loads(trees["tree"].iloc[0])
    return out.assign(bin=tree.place(lengthen(_matrix(out["vector"]), tree.longest)))


def _asking(vector, longest: float) -> np.ndarray:
    """A query as long as the longest vector; its added component is zero."""
    vector = np.asarray(vector, np.float64)
    return np.append(vector * (longest / max(1e-300, float(np.linalg.norm(vector)))), 0.0)


def _walk(tree: Tree, visits: int, members: np.ndarray, least: int):
    def run(batches):
        for batch in batches:
            for asked, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                leaves, away = zip(*tree.visit(_asking(vector, tree.longest), visits, members, least))
                n = len(leaves)
                yield pa.record_batch(
                    [pa.array([asked] * n, pa.int64()), pa.array([vector] * n, pa.list_(pa.float64())), pa.array(leaves, pa.int64()), pa.array(away)],
                    ["asked", "vector", "leaf", "away"],
                )

    return run


def _walk_lower(visits: int, least: int):
    """Bins that one chunk of a leaf's visitors reach in the leaf's own tree."""

    def run(asking: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asking) and len(trees):
            tree, held = pickle.loads(trees["tree"].iloc[0]), trees["held"].iloc[0]
            members = np.zeros(tree.leaves, np.int64)
            for one in held:
                members[one["bin"]] = one["held"]
            for asked, vector, leaf, from_leaf in zip(asking["asked"], asking["vector"], asking["leaf"], asking["away"]):
                reached = tree.visit(_asking(vector, tree.longest), visits, members, least)
                # A tree without a split has no centre; the leaf's own distance stands for it.
                out += [(asked, leaf, at, away if tree.leaves > 1 else from_leaf) for at, away in reached]
        frame = pd.DataFrame(out, columns=["asked", "leaf", "bin", "away"])
        return frame.astype({"asked": "int64", "leaf": "int64", "bin": "int64", "away": "float64"})

    return run


def _chunks(frame: DataFrame, keys: list[str], name: str) -> DataFrame:
    """How many chunks of bounded size the rows of each key make."""
    return frame.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias(name))


def _beside(frame: DataFrame, trees: DataFrame, spread: str):
    """Rows of leaves with a tree of their own, in chunks, cogrouped with copies of that tree."""
    counts = _chunks(frame.join(trees.select("leaf"), "leaf"), ["leaf"], "chunks")
    dealt = frame.join(counts, "leaf").withColumn("chunk", F.pmod(F.xxhash64(spread), F.col("chunks")).cast("int")).drop("chunks")
    copies = trees.join(counts, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    return dealt.groupBy("leaf", "chunk").cogroup(copies.groupBy("leaf", "chunk"))


@dataclass
class Index:
    """Vectors by leaf and bin, the upper tree, and the trees of the leaves that have one."""

    upper: Tree
    members: np.ndarray
    dealt: DataFrame
    bins: DataFrame
    lower: DataFrame | None

    def reach(self, askers: DataFrame, leaves: int, bins: int, least: int) -> DataFrame:
        """``asked, leaf, bin, place`` of the bins in reach that hold rows, nearest first: so many of
        so many leaves, and more until they hold ``least`` ids."""
        walk = _walk(self.upper, leaves, self.members, least)
        visitors = materialize(askers.select("asked", "vector").mapInArrow(walk, "asked long, vector array<double>, leaf long, away double"))
        if self.lower is None:
            found = visitors.select("asked", "leaf", F.lit(0).cast("long").alias("bin"), "away")
        else:
            flat = visitors.join(self.lower.select("leaf"), "leaf", "left_anti")
            held = self.bins.groupBy("leaf").agg(F.collect_list(F.struct("bin", "held")).alias("held"))
            deep = _beside(visitors, self.lower.join(held, "leaf"), "asked").applyInPandas(
                _walk_lower(bins, least), "asked long, leaf long, bin long, away double"
            )
            found = flat.select("asked", "leaf", F.lit(0).cast("long").alias("bin"), "away").union(deep)
        nearest_first = Window.partitionBy("asked").orderBy("away", "leaf", "bin")
        before = F.coalesce(F.sum("held").over(nearest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = found.join(self.bins, ["leaf", "bin"]).withColumns({"place": F.row_number().over(nearest_first), "before": before})
        return placed.where((F.col("place") <= bins) | (F.col("before") < least)).select("asked", "leaf", "bin", "place")


def build_index(groups: DataFrame, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Deal distinct vectors (``vector, ids``) of one length to bins of about ``leaf_rows``."""
    total, longest = groups.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()
    longest = math.sqrt(longest)
    step_rows = max(1, total // sample_rows)
    chosen = groups.where(F.pmod(F.xxhash64("vector"), F.lit(step_rows)) == 0).select("vector").limit(2 * sample_rows).toPandas()
    sample = _matrix(chosen["vector"]) if len(chosen) else _matrix([groups.first()["vector"]])
    upper = grow(sample[np.lexsort(sample.T[::-1])], longest, max(leaf_rows // step_rows, LEAST_ROWS))
    placed = materialize(groups.mapInArrow(_deal(upper), "vector array<double>, ids array<long>, leaf long"))
    # At most two rows of the sample a leaf: these tables are small whatever the input.
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n_leaf"), F.sum(F.size("ids")).alias("n_ids"))
    members, large = np.zeros(upper.leaves, np.int64), False
    for row in sizes.collect():
        members[row.leaf] = row.n_ids
        large = large or row.n_leaf > 2 * leaf_rows
    lower, dealt = None, placed.withColumn("bin", F.lit(0).cast("long"))
    if large:
        crowded = placed.join(F.broadcast(sizes.where(F.col("n_leaf") > 2 * leaf_rows).select("leaf", "n_leaf")), "leaf")
        rate = F.ceil(F.col("n_leaf") / LOWER_ROWS)
        sampled = crowded.where(F.pmod(F.xxhash64("vector", F.lit(1)), rate) == 0).select("leaf", "n_leaf", "vector")
        lower = materialize(sampled.groupBy("leaf").applyInPandas(_grow_lower(longest, leaf_rows), "leaf long, tree binary"))
        deep = _beside(placed, lower, "vector").applyInPandas(_bins_of, "vector array<double>, ids array<long>, leaf long, bin long")
        dealt = materialize(dealt.join(lower.select("leaf"), "leaf", "left_anti").select("vector", "ids", "leaf", "bin").union(deep))
        release(placed)
    bins = materialize(dealt.groupBy("leaf", "bin").agg(F.sum(F.size("ids")).alias("held")))
    return Index(upper, members, dealt, bins, lower)


def _widened(needed: np.ndarray, most: int, share: float) -> int:
    """The fewest visits, of a widening series, within which the wanted share of neighbours lies."""
    visits = 1.0
    while visits < most and (needed < int(visits)).mean() < share:
        visits *= WIDEN
    return min(most, math.ceil(visits))


def calibrate(index: Index, checks: DataFrame, k: int, recall: float) -> tuple[int, int]:
    """Leaves to reach and bins to visit, so that the wanted share of true neighbours over all rows is found.

    ``checks`` are the calibration queries (``asked, vector``).  Half of what
    may be missed is left to the leaves, the rest to the bins within them.
    """
    rows = checks.toPandas()
    if rows.empty:
        return 1, 1
    queries, upper = _matrix(rows["vector"]), index.upper
    found = index.dealt.select("vector", "leaf", "bin").mapInArrow(_brute(queries, k), "query long, score double, leaf long, bin long")
    place = Window.partitionBy("query").orderBy(F.col("score").desc(), "leaf", "bin")
    true = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("query", "leaf", "bin").toPandas()
    order = [{leaf: at for at, (leaf, _) in enumerate(upper.visit(_asking(q, upper.longest), upper.leaves))} for q in queries]
    needed = np.array([order[q].get(leaf, upper.leaves) for q, leaf in zip(true["query"], true["leaf"])])
    leaves = _widened(needed, upper.leaves, (1 + recall) / 2)
    true["asked"] = rows["asked"].to_numpy()[true["query"]]
    wanted = checks.sparkSession.createDataFrame(true[["asked", "leaf", "bin"]])
    most = index.bins.count()
    told = index.reach(checks, leaves, most, 0).join(F.broadcast(wanted), ["asked", "leaf", "bin"]).select("place").toPandas()
    missed = [most] * (len(true) - len(told))
    return leaves, _widened(np.array([*(told["place"] - 1), *missed]), most, recall)


def nearest(rows: DataFrame, step: int = 20, k: int = 20, recall: float = RECALL, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``step``: ``query_id, rank, vec_id, score``.

    Candidates are all rows but the query's own, of the query's length where
    lengths differ (each length has an index of its own).  ``score`` is the
    inner product of the original vectors in double precision; equal scores
    rank by the smaller id.  Rows with a null id, and vectors that are null,
    zero or hold null or non-finite components, take no part.  Of rows that
    repeat an id and vector one counts; a repeated id with several vectors is
    asked once for each and the best scores count.  An empty table gives no
    rows; other columns are ignored.  A walk goes on until the visited bins
    hold ``k`` others, so a query has fewer rows only if there are fewer
    candidates.
    """
    usable = sound(rows)
    lengths = [r.n for r in usable.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    parts = [_nearest_of_length(usable.where(F.size("vector") == n), step, k, recall, leaf_rows, sample_rows) for n in lengths]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    told = parts[0]
    for part in parts[1:]:
        told = told.union(part)
    several = usable.where(F.col("vec_id") % step == 0).distinct().groupBy("vec_id").count().where("count > 1").limit(1).count()
    if not several:
        return told
    rank = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    merged = told.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(rank))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distinct_vectors(usable: DataFrame, k: int) -> DataFrame:
    """``vector, ids``; of equal vectors only the smallest ids can be among the nearest, and one more, as a
    query isn't its own candidate."""
    place = Window.partitionBy("vector").orderBy("vec_id")
    ranked = usable.distinct().withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _nearest_of_length(usable: DataFrame, step: int, k: int, recall: float, leaf_rows: int, sample_rows: int) -> DataFrame:
    groups = materialize(distinct_vectors(usable, k))
    index = build_index(groups, leaf_rows, sample_rows)
    release(groups)
    queries = usable.where(F.col("vec_id") % step == 0).distinct()
    # A vector is asked once, however many ids it has; its smallest id names it.
    askers = materialize(queries.groupBy("vector").agg(F.min("vec_id").alias("asked")))
    checks = askers.orderBy(F.xxhash64("asked"), "asked").limit(CALIBRATION_QUERIES)
    leaves, bins = calibrate(index, checks.select("asked", "vector"), k, recall)
    visitors = materialize(index.reach(askers, leaves, bins, k + 1).join(askers, "asked").select("asked", "vector", "leaf", "bin"))
    # Members and visitors of a bin are both dealt to chunks; every pair of chunks is one group of bounded size.
    keys = ["leaf", "bin"]
    sizes = _chunks(index.dealt, keys, "across").join(_chunks(visitors, keys, "down"), keys)
    columns = [*keys, "one", "two", "asked", "vector", "ids", "asks"]
    members = index.dealt.join(sizes, keys).withColumns(
        {
            "one": F.pmod(F.xxhash64("vector"), F.col("across")).cast("int"), "two": F.explode(F.sequence(F.lit(0), F.col("down") - 1)),
            "asked": F.lit(None).cast("long"), "asks": F.lit(False),
        }
    )
    asking = visitors.join(sizes, keys).withColumns(
        {
            "two": F.pmod(F.xxhash64("asked"), F.col("down")).cast("int"), "one": F.explode(F.sequence(F.lit(0), F.col("across") - 1)),
            "ids": F.lit(None).cast("array<long>"), "asks": F.lit(True),
        }
    )
    found = members.select(columns).union(asking.select(columns)).groupBy(*keys, "one", "two").applyInPandas(
        _top(k + 1), "asked long, vec_id long, score double"
    )
    place = Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id")
    best = found.groupBy("asked", "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(place))
    lists = best.where(F.col("place") <= k + 1).groupBy("asked").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id", "score"))).alias("near")
    )
    ids = queries.join(askers, "vector").select(F.col("vec_id").alias("query_id"), "asked")
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    told = ids.join(lists, "asked").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "hit"))
    return told.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
