"""Merkle manifest of a table of documents, with inclusion proofs by pointer jumping.

1. A leaf is the digest of a row's fields. Leaves are put in order within their source by one
   range-partitioned sort and numbered from counts by partition, so that a source of any
   size is dealt over tasks.
2. Every ARITY neighbouring nodes make one of the next level, until one is left: the
   source's subroot. Subroots, in the order of their sources, make the root likewise.
3. Each node starts with a pointer to its parent and the run of digests that it stands in (with
   its place there). A self-join of all nodes on the pointer puts the ancestor's pointer in
   place of a node's own and the ancestor's segments behind its own; so distances double from
   round to round until no pointer is left and all leaves hold their whole way to the root.
4. A proof is folded from the leaf to the root; a text that was changed gives another root.

Column expressions only. Digests are hashed as lowercase hex text and stored as bytes.

Defined cases: null fields are `-`; rows without a source are a source of their own, the
first; rows without an id come first in their source; rows that repeat an id stand in the order
of their digests, equal rows one after the other; a lone leaf is its source's subroot, a lone
source's subroot is the root; an empty table gives no rows; other columns are neither read nor
returned.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Level of a node in its number within a tree, and the tree of the subroots.
LEVEL, TOP = 1 << 50, -1


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of the fields, each told by its length; null is told from an empty value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[part(c) for c in fields.values()]))


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Written ``df`` with (idx, n): each row's place in its group, and the group's rows.

    Rows are sorted by ranges; a row's place is its place in its task plus the group's rows in
    tasks before. ``order`` begins with the group's columns and tells all rows apart.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranged")
    parts = ranged.groupBy(*group, "part").agg(F.count("*").alias("own"), F.min("at").alias("first"))
    w = Window.partitionBy(*group)  # a row a task and group
    before = F.coalesce(F.sum("own").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"before": before - F.col("first"), "n": F.sum("own").over(w)}).drop("own", "first")
    both = ranged.alias("r").join(parts.alias("p"), [F.col("r.part") == F.col("p.part"), *[F.col(f"r.{g}").eqNullSafe(F.col(f"p.{g}")) for g in group]])
    return written(both.select(*[f"r.{c}" for c in df.columns], (F.col("at") + F.col("before")).alias("idx"), "n"), "numbered")


def _runs(nodes: DataFrame) -> DataFrame:
    """Written (tree, parent, n, size, run, children): neighbours of one parent; ``nodes`` has
    (tree, idx, n, size, digest, doc), with ``size`` the number of its level in its tree."""
    child = F.struct("idx", "digest", "doc")
    found = nodes.groupBy("tree", F.expr(f"idx div {ARITY}").alias("parent"), "n", "size").agg(F.sort_array(F.collect_list(child)).alias("children"))
    run = F.array_join(F.transform("children", lambda c: hexed(c["digest"])), "")
    return written(found.withColumn("run", F.unhex(run)), "runs")


def _above(runs: DataFrame) -> DataFrame:
    """The next level of nodes."""
    return runs.select("tree", F.col("parent").alias("idx"), "n", F.ceil(F.col("size") / ARITY).alias("size"), digest(hexed(F.col("run"))).alias("digest"), F.lit(None).cast(_DOC).alias("doc"))


_DOC = "struct<id:bigint,leaf:binary,changed:binary,height:int>"
_SEGMENTS = "array<struct<place:int,run:binary>>"


@dataclass
class Tree:
    """Levels of a forest: nodes with one segment each, and what each tree ends in."""

    nodes: list[DataFrame]
    roots: list[DataFrame]


def _grown(level: DataFrame, top: bool) -> Tree:
    """All levels above ``level``; its pointers end below the root of all if this is ``top``."""
    found, number = Tree([], []), 0
    while True:
        found.roots.append(level.where("size = 1"))
        runs = _runs(level.where("size > 1"))
        if runs.isEmpty():
            return found
        child = F.col("child")
        last = F.lit(top) & (F.col("size") <= ARITY)
        nodes = runs.select("tree", "parent", "size", "run", F.explode("children").alias("child")).select(
            "tree", (F.lit(number * LEVEL) + child["idx"]).alias("node"), F.when(~last, F.col("tree")).alias("to_tree"),
            F.when(~last, F.lit((number + 1) * LEVEL) + F.col("parent")).alias("to_node"),
            F.array(F.struct((child["idx"] % ARITY).cast("int").alias("place"), "run")).alias("segments"), child["doc"].alias("doc"),
        )
        found.nodes.append(nodes)
        level, number = _above(runs), number + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def jumped(nodes: DataFrame, rounds: int = 8) -> DataFrame:
    """``nodes`` (tree, node, to_tree, to_node, segments, ..) with all pointers followed to their
    end: each round joins the nodes with themselves, so that distances double."""
    nodes = written(nodes, "nodes")
    for _ in range(rounds):
        ahead = nodes.where("to_node is not null")
        if ahead.isEmpty():
            return nodes
        up = nodes.select(F.col("tree").alias("to_tree"), F.col("node").alias("to_node"), F.col("to_tree").alias("next_tree"), F.col("to_node").alias("next_node"), F.col("segments").alias("more"))
        both = ahead.join(up, ["to_tree", "to_node"])
        kept = [c for c in nodes.columns if c not in ("to_tree", "to_node", "segments")]
        moved = both.select(*kept, F.col("next_tree").alias("to_tree"), F.col("next_node").alias("to_node"), F.concat("segments", "more").alias("segments"))
        nodes = written(moved.unionByName(nodes.where("to_node is null"), allowMissingColumns=False), "nodes")
    if not nodes.where("to_node is not null").isEmpty():
        raise RuntimeError(f"pointers have not reached the root in {rounds} rounds")
    return nodes


def siblings(segment: Column) -> Column:
    """Hex digests of a segment's run, without the node's own."""
    run, at = hexed(segment["run"]), segment["place"] * 64
    return F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 65))


def folded(leaf: Column, segments: Column) -> Column:
    """Hex root that a leaf and the siblings on its way give."""

    def step(own: Column, segment: Column) -> Column:
        run, at = hexed(segment["run"]), segment["place"] * 64
        return F.sha2(F.concat(F.substr(run, F.lit(1), at), own, F.substr(run, at + 65)), 256)

    return F.aggregate(segments, hexed(leaf), step)


def leaves(docs: DataFrame, changed_text: Column | None = None, changed: Column | None = None) -> DataFrame:
    """(source, id, leaf, changed, row): ``changed`` is the digest with ``changed_text`` where
    the condition ``changed`` holds."""
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    other = F.lit(None).cast("binary") if changed is None else F.when(changed, leaf_digest(fields | {"text": changed_text}))
    return docs.select(
        fields["source"].alias("source"), fields["doc_id"].cast("bigint").alias("id"), leaf_digest(fields).alias("leaf"), other.alias("changed"), F.monotonically_increasing_id().alias("row"),
    )


def proofs(marked: DataFrame) -> DataFrame:
    """(id, leaf, changed, subroot, root, segments) of each of ``leaves``: digests as bytes."""
    places = numbered(written(marked, "leaves"), ["source"], ["source", "id", "leaf", "row"])
    sources = numbered(places.where("idx = 0").select("source"), [], ["source"]).select(F.col("source"), F.col("idx").alias("tree"), F.col("n").alias("sources"))
    height = F.size(F.filter(F.array(*[F.lit(ARITY**k) for k in range(15)]), lambda most: most < F.col("n")))
    placed = places.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")))
    doc = F.struct("id", "leaf", "changed", height.alias("height"))
    lowest = written(placed.select("tree", "idx", "n", F.col("n").alias("size"), F.col("leaf").alias("digest"), doc.alias("doc"), "sources"), "lowest")
    one_source = lowest.where("sources > 1").isEmpty()
    below = _grown(lowest.drop("sources"), top=one_source)
    subroots = written(_union([r.select("tree", "digest", F.lit(i).alias("level"), "idx", "doc") for i, r in enumerate(below.roots)]), "subroots")
    if one_source:
        return _told(jumped(_union(below.nodes)) if below.nodes else None, subroots)
    n = F.lit(subroots.count()).cast("bigint")
    level = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), n.alias("n"), n.alias("size"), "digest", F.lit(None).cast(_DOC).alias("doc"))
    above = _grown(level, top=True)
    # a source's subroot is a leaf of the top tree: one node, under its name in its source
    own = subroots.select("tree", (F.col("level") * LEVEL + F.col("idx")).alias("node"), "doc")
    first = above.nodes[0].drop("tree", "doc").withColumnRenamed("node", "ordinal").join(own, F.col("ordinal") == F.col("tree")).drop("ordinal")
    return _told(jumped(_union([*below.nodes, first, *above.nodes[1:]])), above.roots[-1])


def _told(nodes: DataFrame | None, roots: DataFrame) -> DataFrame:
    """Leaves of ``nodes`` with their digests; without nodes the only leaf is the root."""
    if nodes is None:
        alone = roots.where("doc is not null").select("doc.*").withColumn("segments", F.array().cast(_SEGMENTS))
        return alone.select("id", "leaf", "changed", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), "segments")
    root = F.lit(bytes(roots.first().digest))  # one digest
    at = F.get(F.col("segments"), F.col("doc.height"))
    subroot = F.coalesce(F.substr(at["run"], at["place"] * 32 + 1, F.lit(32)), root)
    return nodes.where("doc is not null").select("doc.id", "doc.leaf", "doc.changed", subroot.alias("subroot"), root.alias("root"), "segments")


def manifest(docs: DataFrame, every: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row. In one of
    ``every`` rows, told by the checksum of the id, the text is lower-cased after the manifest
    was made, and its proof is folded from the changed leaf."""
    text, name = F.col("text"), F.col("doc_id").cast("string")
    found = proofs(leaves(docs, lowered(text), F.coalesce(F.crc32(name.cast("binary")) % every == 0, F.lit(False))))
    proof = F.sha2(F.array_join(F.transform("segments", siblings), ""), 256)
    out = found.select(
        F.col("id").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        proof.alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("segments")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 6, top_levels: int = 4) -> str:
    """The same rows in DuckDB SQL, with a fixed number of levels: up to 16^6 rows a source and
    16^4 sources."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(text if c == "text" else c) for c in FIELDS) + ")"
    steps = "[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]"
    crc = (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: {steps}))), "
        "lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    )
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} END AS changed FROM documents)",
        "a0 AS (SELECT source AS t, doc_id, leaf, coalesce(changed, leaf) AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, '' AS proof FROM d)",
        "ag0 AS (SELECT t, idx, n, leaf AS digest FROM a0)",
    ]

    def climb(tag: str, k: int, kept: str) -> list[str]:
        """Level k + 1 of the nodes ``{tag}g``, and the ways of the rows ``{tag}`` up to it."""
        run = f"{tag}r{k}"
        left, right = f"array_to_string(run[:(idx // {ARITY**k}) % {ARITY}], '')", f"array_to_string(run[(idx // {ARITY**k}) % {ARITY} + 2:], '')"
        return [
            f"{run} AS (SELECT t, idx // {ARITY} AS parent, n, list(digest ORDER BY idx) AS run FROM {tag}g{k} GROUP BY ALL)",
            f"{tag}g{k + 1} AS (SELECT t, parent AS idx, n, CASE WHEN n > {ARITY**k} THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM {run})",
            f"""{tag}{k + 1} AS (SELECT {kept}, x.t, idx, x.n, CASE WHEN x.n > {ARITY**k} THEN proof || {left} || {right} ELSE proof END AS proof,
                CASE WHEN x.n > {ARITY**k} THEN sha256({left} || h || {right}) ELSE h END AS h FROM {tag}{k} AS x JOIN {run} AS r ON x.t IS NOT DISTINCT FROM r.t AND idx // {ARITY ** (k + 1)} = parent)""",
        ]

    for k in range(levels):
        parts += climb("a", k, "doc_id, leaf")
    parts += [
        f"s AS (SELECT t AS source, digest AS subroot, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM ag{levels})",
        f"b0 AS (SELECT doc_id, leaf, subroot, 0 AS t, s.idx, s.n, proof, h FROM a{levels} AS x JOIN s ON x.t IS NOT DISTINCT FROM s.source)",
        "bg0 AS (SELECT 0 AS t, idx, n, subroot AS digest FROM s)",
    ]
    for k in range(top_levels):
        parts += climb("b", k, "doc_id, leaf, subroot")
    last = f"SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = digest AS verified FROM b{top_levels} CROSS JOIN (SELECT digest FROM bg{top_levels})"
    return "WITH " + ",\n".join(parts) + "\n" + last


SQL = _sql()
