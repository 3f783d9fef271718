"""Density clustering: topics of any number and shape, with outliers.

1. A graph of nearest neighbours gives each point a core distance (that of its LEAST_SAMPLES-th
   neighbour) and each edge its mutual reachability: the larger of its length and both cores.
2. Its minimum spanning forest is found in rounds: every component takes its shortest edge out,
   pointers are jumped to the roots, and edges within a component go. Components at least halve.
3. Points come together from the shortest edge up. ``arrivals`` finds, for all points at once, the
   edge by which each first belongs to a component of LEAST_CLUSTER points, by walks that about
   double in a turn; edges that join two such components are splits, of which there are at
   most n / LEAST_CLUSTER.
4. The splits alone make the condensed tree. A cluster's stability is what its points gain in
   density (1 / length) while they are in it; the most stable clusters without overlap are
   topics, and what belongs to none is an outlier (-1).

Steps 1 to 3 are joins and partial aggregates over edges; the driver sees the splits and a row a
cluster. Edges of one length are told apart by their ends, so results are the same
wherever rows lie. Points without an edge are outliers; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import stored

LEAST_SAMPLES, LEAST_CLUSTER = 5, 20
#: Points that a walk asks in a turn.
ASKED = 6
#: Rounds by which points come together before their first walks, and points that walk in one task at once.
ROUNDS, PART_POINTS, LEAST_PARTS = 4, 10_000, 64
#: Density of points that lie on each other, and clusters that a task may be sent.
SHORTEST, MOST_CLUSTERS = 1e-9, 2_000_000
_EDGE = "struct<w:double,a:bigint,b:bigint>"


def reachability(neighbours: DataFrame, samples: int = LEAST_SAMPLES) -> DataFrame:
    """(a, b, w) with a < b: edges of (query, id, distance, rank) by mutual reachability."""
    core = neighbours.groupBy("query").agg(F.max(F.when(F.col("rank") <= samples, F.col("distance"))).alias("core"))
    pair = neighbours.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "distance").where("a != b")
    pair = pair.groupBy("a", "b").agg(F.min("distance").alias("w"))
    both = pair.join(core.withColumnsRenamed({"query": "a", "core": "ca"}), "a", "left").join(core.withColumnsRenamed({"query": "b", "core": "cb"}), "b", "left")
    return both.select("a", "b", F.greatest("w", "ca", "cb").alias("w"))


def _jumped(pointers: DataFrame) -> DataFrame:
    """(node, root) of pointers (node, to); a root points to itself, and so does the smaller of two
    that point to each other."""
    up = lambda p: p.select(F.col("node").alias("to"), F.col("to").alias("next"))
    twice = lambda p: p.join(up(p), "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
    first = pointers.join(up(pointers), "to").select("node", F.when(F.col("next") == F.col("node"), F.least("node", "to")).otherwise(F.col("to")).alias("to"))
    found = stored(twice(first), "pointers")
    while not found.where("moved").isEmpty():
        found = stored(twice(twice(found.select("node", "to")).select("node", "to")), "pointers")
    return found.select("node", F.col("to").alias("root"))


def _relabelled(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (ca, cb, e) with their ends' new names (node, root), those not named as they are."""
    for c in ("ca", "cb"):
        edges = edges.join(names.withColumnsRenamed({"node": c, "root": f"{c}_new"}), c, "left").withColumn(c, F.coalesce(f"{c}_new", c)).drop(f"{c}_new")
    return edges.select("ca", "cb", "e")


def _shortest(edges: DataFrame) -> DataFrame:
    """(node, best) of each component at an end of ``edges``: its shortest edge and where to."""
    ends = [edges.select(F.col(x).alias("node"), F.struct("e", F.col(y).alias("to")).alias("best")) for x, y in (("ca", "cb"), ("cb", "ca"))]
    return ends[0].unionByName(ends[1]).groupBy("node").agg(F.min("best").alias("best"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Stored (e): the minimum spanning forest of ``edges`` (a, b, w)."""
    live = stored(edges.where("a < b").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("w", "a", "b").cast(_EDGE).alias("e")), "edges")
    found = None
    while not live.isEmpty():
        best = stored(_shortest(live), "shortest")
        own = best.select(F.col("best.e").alias("e"))
        found = own if found is None else found.unionByName(own)
        names = _jumped(best.select("node", F.col("best.to").alias("to")))
        named = _relabelled(live, names).where("ca != cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "e")
        live = stored(named.groupBy("ca", "cb").agg(F.min("e").alias("e")), "edges")
    return stored((live.select("e") if found is None else found).distinct(), "forest")


@dataclass(frozen=True)
class Arrivals:
    """Stored (node, region, arrival) of points, and (ca, cb, e) of splits between regions. A point
    whose tree is too small has no arrival."""

    points: DataFrame
    splits: DataFrame


def _ahead(edges: list[tuple[float, int, int, bool]]) -> dict[int, list]:
    """Directed edges (w, from, to, known) by where they begin, as they are compared."""
    out: dict[int, list] = {}
    for e in edges:
        out.setdefault(e[1], []).append((e[0], min(e[1:3]), max(e[1:3]), e))
    return out


def _walk(start: int, out: dict[int, list], least: int) -> tuple[list[tuple[float, int, int, bool]], bool]:
    """Edges of a tree in the order in which ``start`` takes them, always the shortest that leads on,
    till it has ``least`` points; and whether that order is certain: all points that had to be
    passed are known, those whose own edges are at hand."""
    taken, certain, heap = [], True, list(out.get(start, ()))
    heapq.heapify(heap)
    while heap and len(taken) < least - 1:
        e = heapq.heappop(heap)[3]
        taken.append(e)
        certain &= e[3] or len(taken) == least - 1
        for x in out.get(e[2], ()):
            if x[3][2] != e[1]:  # not back
                heapq.heappush(heap, x)
    return taken, certain


_WALK = "node bigint, w array<double>, `from` array<bigint>, `to` array<bigint>, known array<boolean>, done boolean"


def _parts(forest: DataFrame) -> DataFrame:
    """(node, part): points of one component have one part, after as many of ROUNDS rounds of shortest
    edges as leave it PART_POINTS at most; what is larger after the first is dealt. Few points are one part."""
    live, names, found = forest.select(F.col("e.a").alias("ca"), F.col("e.b").alias("cb"), "e"), None, None
    n = forest.count()
    if n < PART_POINTS:
        return live.select(F.explode(F.array("ca", "cb")).alias("node")).distinct().select("node", F.lit(0).cast("bigint").alias("part"))
    share = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / F.lit(PART_POINTS)))
    for _ in range(ROUNDS):
        roots = _jumped(stored(_shortest(live).select("node", F.col("best.to").alias("to")), "shortest"))
        higher = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        names = roots if names is None else names.join(higher, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        sized = names.join(names.groupBy("root").agg(F.count("*").alias("n")), "root")
        if found is None:
            found = sized.select("node", F.xxhash64("root", share).alias("part"))
        else:
            found = sized.join(found, "node").select("node", F.when(F.col("n") <= PART_POINTS, F.xxhash64("root")).otherwise(F.col("part")).alias("part"))
        live = stored(_relabelled(live, roots).where("ca != cb"), "edges")
        if live.isEmpty():
            break
    parts = max(LEAST_PARTS, -(-n // PART_POINTS))
    return stored(found.select("node", F.pmod("part", F.lit(parts)).alias("part")), "parts")


def _walks(forest: DataFrame, least: int) -> DataFrame:
    """Stored _WALK of each point: its first edges as ``_walk`` takes them.

    Points that come together in ROUNDS rounds of shortest edges walk among each other first, as many
    as fit a part; most walks end there. In each turn a point asks the first ASKED points of its walk whose
    edges it doesn't have for their walks, and takes what lies beyond them. In a tree the order of
    the points beyond one doesn't depend on where a walk comes from, and whatever a walk
    takes beyond a point is among the first of that point's own walk, so ``least`` edges a point
    are enough. A walk about doubles in a turn.
    """
    ends = [forest.select(F.col(f"e.{x}").alias("node"), F.col(f"e.{y}").alias("to"), "e") for x, y in (("a", "b"), ("b", "a"))]
    near = ends[0].unionByName(ends[1]).withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("e"))).where(F.col("n") < least)
    kinds = pa.schema([("node", pa.int64()), ("w", pa.list_(pa.float64())), ("from", pa.list_(pa.int64())), ("to", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("done", pa.bool_())])

    def begin(table):
        out, own = {n: [] for n in kinds.names}, table.column("node").to_pylist()
        here = set(own)
        ahead = _ahead([(w, i, j, j in here) for w, i, j in zip(table.column("w").to_pylist(), own, table.column("to").to_pylist(), strict=True)])
        for node in sorted(here):
            taken, done = _walk(node, ahead, least)
            for column, value in zip(out.values(), (node, *([e[c] for e in taken] for c in range(4)), done), strict=True):
                column.append(value)
        return pa.table(out, schema=kinds)

    def run(batches):
        for batch in batches:
            out = {n: [] for n in kinds.names}
            for node, w, frm, to, known, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here = {t["at"] for t in told}
                edges = [(x, i, j, k or j in here) for x, i, j, k in zip(w, frm, to, known, strict=True)]
                for t in told:
                    back = {t["via"]}  # what lies on the side that the walk comes from
                    for x, i, j, k in zip(t["w"], t["from"], t["to"], t["known"], strict=True):
                        if j in back or i in back:
                            back.add(j)
                        else:
                            edges.append((x, i, j, k))
                taken, done = _walk(node, _ahead(edges), least)
                for column, value in zip(out.values(), (node, *([e[c] for e in taken] for c in range(4)), done), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    parts = _parts(forest)
    state = stored(near.select("node", "to", "e.w").join(parts, "node").groupBy("part").applyInArrow(begin, _WALK), "walks")
    while not (open_ := state.where("not done")).isEmpty():
        unknown = F.filter(F.arrays_zip(F.col("from").alias("via"), F.col("to").alias("at"), "known"), lambda x: ~x["known"])
        asked = open_.select("node", F.explode(F.slice(unknown, 1, ASKED)).alias("x")).select("node", "x.via", "x.at")
        told = asked.join(state.drop("done").withColumnRenamed("node", "at"), "at")
        told = told.groupBy("node").agg(F.collect_list(F.struct("at", "via", "w", "from", "to", "known")).alias("told"))  # ASKED at most
        new = open_.drop("done").join(told, "node").mapInArrow(run, _WALK)
        state = stored(new.unionByName(state.where("done")), "walks")
    return state


def arrivals(forest: DataFrame, least: int = LEAST_CLUSTER) -> Arrivals:
    """For each point the edge by which its component first has ``least`` points: the longest that
    it takes on its walk to that many.

    An edge longer than the arrivals of both its ends is a split. Points that arrive by one edge
    arrive together: where one of its ends has arrived before, in that end's region, else in
    a region of their own, named by the smallest of them. So regions are chains of arrivals.
    """
    walks = _walks(forest, least)
    edges = F.transform(F.arrays_zip("w", "from", "to"), lambda x: F.struct(x["w"].alias("w"), F.least(x["from"], x["to"]).alias("a"), F.greatest(x["from"], x["to"]).alias("b")))
    arrived = stored(walks.select("node", F.when(F.size("w") >= least - 1, F.array_max(edges)).cast(_EDGE).alias("arrival")), "arrived")
    there = arrived.where("arrival is not null")
    named = stored(there.join(there.groupBy("arrival").agg(F.min("node").alias("own")), "arrival").select("node", "own", "arrival"), "named")
    ends = [named.select(F.col("node").alias(f"arrival_{c}"), F.col("own").alias(f"own_{c}"), F.col("arrival").alias(f"by_{c}")) for c in "ab"]
    heads = named.select("own", "arrival").distinct()
    for c, end in zip("ab", ends, strict=True):
        heads = heads.withColumn(f"arrival_{c}", F.col(f"arrival.{c}")).join(end, f"arrival_{c}")
    to = F.when(F.col("by_a") < F.col("arrival"), F.col("own_a")).when(F.col("by_b") < F.col("arrival"), F.col("own_b")).otherwise(F.col("own"))
    roots = _jumped(stored(heads.select(F.col("own").alias("node"), to.alias("to")), "heads")).withColumnsRenamed({"node": "own", "root": "region"})
    points = stored(named.join(roots, "own").select("node", "region", "arrival").unionByName(arrived.where("arrival is null").select("node", F.col("node").alias("region"), "arrival")), "points")
    splits = forest.select("e", F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    for c in "ab":
        splits = splits.join(points.toDF(c, f"c{c}", f"by_{c}"), c)
    return Arrivals(points, stored(splits.where("by_a < e and by_b < e").select("ca", "cb", "e"), "splits"))


class Tree:
    """The condensed tree of regions and splits. Clusters are numbered regions first, then as they
    come together, last the root of all."""

    def __init__(self, regions: list[int], splits: list[tuple[float, int, int, int, int]]) -> None:
        self.splits = sorted(splits)
        number = {r: i for i, r in enumerate(sorted(regions))}
        total = len(number) + len(splits) + 1
        self.parent, self.turn, self.split = np.full(total, -1), np.full(total, len(splits)), np.full(total, np.inf)
        top = list(range(total))

        def find(c: int) -> int:
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        for k, (w, _, _, x, y) in enumerate(self.splits):
            own = len(number) + k
            self.split[own] = w
            for c in (find(number[x]), find(number[y])):
                top[c], self.parent[c], self.turn[c] = own, own, k
        tops = [c for c in range(total - 1) if self.parent[c] < 0]
        self.root = tops[0] if len(tops) == 1 else total - 1
        if len(tops) != 1:
            self.parent[tops] = self.root
        self.number = number

    def turns(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many splits are shorter than each edge."""
        lengths = np.array([s[0] for s in self.splits])
        low, high = np.searchsorted(lengths, w, "left"), np.searchsorted(lengths, w, "right")
        for i in np.flatnonzero(low != high):
            low[i] += sum(s[:3] < (w[i], a[i], b[i]) for s in self.splits[low[i] : high[i]])
        return low

    def cluster(self, region: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The cluster that a point of a region leaves alone: the one that it came to by its arrival."""
        own = np.array([self.number[r] for r in region.tolist()], dtype=np.int64)
        while len(climb := np.flatnonzero((self.turn[own] < turn) & (self.parent[own] >= 0))):
            own[climb] = self.parent[own[climb]]
        return own

    def chosen(self, counts: dict[int, tuple[int, float]]) -> dict[int, int]:
        """{cluster: topic}: for the most stable clusters and all below them; ``counts`` has the
        points that leave each cluster and the sum of their densities."""
        n = np.array([counts.get(c, (0, 0.0))[0] for c in range(len(self.parent))])
        gain = np.array([counts.get(c, (0, 0.0))[1] for c in range(len(self.parent))])
        children: list[list[int]] = [[] for _ in self.parent]
        for c, p in enumerate(self.parent.tolist()):
            if p >= 0:
                children[p].append(c)
        density = lambda w: 0.0 if np.isinf(w) else 1 / max(w, SHORTEST)
        size, value, best = n.copy(), np.zeros(len(n)), {}
        for c in range(len(self.parent)):  # children come before their parents
            born = density(self.split[self.parent[c]]) if self.parent[c] >= 0 else 0.0
            size[c] += sum(size[k] for k in children[c])
            own = gain[c] - n[c] * born + sum(int(size[k]) for k in children[c]) * (density(self.split[c]) - born if children[c] else 0.0)
            below = sum(value[k] for k in children[c])
            value[c], best[c] = (own, True) if own >= below and c != self.root else (below, False)
        topics, todo = [], [self.root]
        while todo:
            c = todo.pop()
            if best[c] and size[c]:
                topics.append(c)
            elif not best[c]:
                todo += children[c]
        out = {}
        for topic, c in enumerate(sorted(topics, key=lambda c: (-size[c], c))):
            todo = [c]
            while todo:
                k = todo.pop()
                out[k] = topic
                todo += children[k]
        return out


def clusters(points: DataFrame, neighbours: DataFrame, key: str, samples: int = LEAST_SAMPLES, least: int = LEAST_CLUSTER) -> DataFrame:
    """(key, topic, probability) of all ``points``, by their (query, id, distance, rank). Topics are
    numbered by falling size; an outlier is -1 with probability 0. The probability is a
    point's density as a share of the largest of its topic."""
    found = arrivals(spanning_forest(reachability(neighbours, samples)), least)
    there = found.points.where("arrival is not null")
    splits = [(r.e.w, r.e.a, r.e.b, r.ca, r.cb) for r in found.splits.collect()]  # at most points / least
    regions = [r.region for r in there.select("region").distinct().collect()]
    if len(regions) + len(splits) > MOST_CLUSTERS:
        raise ValueError(f"{len(regions) + len(splits)} clusters are more than a task should hold; take a larger least size")
    tree = Tree(regions, splits)

    def run(batches):
        for batch in batches:
            e = batch.column(2)
            w, a, b = (e.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            own = tree.cluster(batch.column(1).to_numpy(), tree.turns(w, a, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(1 / np.maximum(w, SHORTEST))], names=["node", "cluster", "density"])

    left = stored(there.mapInArrow(run, "node bigint, cluster bigint, density double"), "left")
    counts = {r.cluster: (r.n, r.s) for r in left.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("density").alias("s")).collect()}
    topics = tree.chosen(counts)
    names = points.sparkSession.createDataFrame(list(topics.items()), "cluster bigint, topic int")
    told = left.join(names, "cluster")
    most = told.groupBy("topic").agg(F.max("density").alias("most"))
    told = told.join(most, "topic").select(F.col("node").alias(key), "topic", (F.col("density") / F.col("most")).alias("probability"))
    out = points.select(F.col(key).cast("bigint").alias(key)).distinct().join(told, key, "left")
    return out.select(key, F.coalesce("topic", F.lit(-1)).alias("topic"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def outlier_share(assigned: DataFrame) -> DataFrame:
    """(topics, outliers, outlier_pct) of assignments."""
    outliers = F.count_if(F.col("topic") == -1)
    return assigned.agg(F.count_distinct(F.when(F.col("topic") >= 0, F.col("topic"))).alias("topics"), outliers.alias("outliers"), F.round(100.0 * outliers / F.count("*"), 1).alias("outlier_pct"))
