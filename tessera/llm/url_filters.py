"""URL filters: host and path rules, then a path-template tree for what no rule covers.

Every URL's whole path is a branch of its host's tree: runs of digits become ``<n>``. Nodes are
told by the names on the way to them. At each node, children that are mostly distinct become ``*``.
Of the others, siblings with ``EVIDENCE`` labels or more are put into ``CELLS`` cells by their
smoothed share of blocked pages; neighbouring cells join while a test of two proportions finds
their shares equal, and a sibling takes the name of its class unless its own share contradicts the
class's. So statistically similar branches merge, wherever their share lies. After each of
``PASSES`` passes the names make the nodes of the next one, so that children below merged
branches are counted together. URLs that a rule covers are the labels. A template's purity is its
share of blocked labels, smoothed by the share of the same path over all hosts, and that by the
share of all labels; templates at ``REJECT`` or more are blocked.

DataFrame functions only. Pages are aggregated by (host, path shape) before any further
shuffle, and statistics are kept for these groups, so a hot host is a few rows. The node above a
segment is a running exclusive-or of 128-bit hashes along the path: work is linear in its depth.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged by
the share of all labels; repeated rows are judged alike, each by itself; without labels all
are allowed; a purity of exactly ``REJECT`` blocks; siblings with few labels keep their own name;
an empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: A node's children are variable if it has so many pages, and so large a share is distinct.
VARIABLE_PAGES, VARIABLE_SHARE = 20, 0.5
#: Labels that a sibling needs to be merged, cells of share, standard errors that equal shares may be apart, passes.
EVIDENCE, CELLS, ALIKE, PASSES = 4, 16, 2.58, 2
#: Width of the confidence bounds, weight of a prior share, share at which to block.
BOUND, PRIOR, REJECT = 1.96, 2.0, 0.5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_longest_rule(rules, host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _equal(b1: Column, l1: Column, b2: Column, l2: Column) -> Column:
    """Whether two shares b / l may be equal, by the test of two proportions."""
    share = (b1 + b2) / (l1 + l2)
    return F.abs(b1 / l1 - b2 / l2) <= ALIKE * F.sqrt(share * (1.0 - share) * (1.0 / l1 + 1.0 / l2))


def _merged(levels: DataFrame) -> DataFrame:
    """One pass: ``levels`` with the names that siblings get where ``name`` tells the nodes."""
    above = Window.partitionBy("key").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "level", "name")).over(above) for i in (1, 2)]
    marks = [F.coalesce(m, F.lit(0)) for m in marks]
    levels = levels.withColumns({"parent": F.struct("at", marks[0].alias("x"), marks[1].alias("y"))})
    smooth = (F.col("b") + 1.0) / (F.col("l") + 2.0)
    children = levels.groupBy("parent", "segment").agg(
        F.sum("n").alias("pages"), F.sum("labelled").cast("double").alias("l"), F.sum("blocked").cast("double").alias("b")
    ).withColumn("cell", F.when(F.col("l") >= EVIDENCE, F.floor(smooth * CELLS)))
    nodes = children.groupBy("parent").agg(F.sum("pages").alias("all"), F.count("*").alias("kinds"))
    variable = (F.col("all") >= VARIABLE_PAGES) & (F.col("kinds") >= VARIABLE_SHARE * F.col("all"))
    nodes = nodes.select("parent", variable.alias("variable"))

    cells = children.where("cell is not null").groupBy("parent", "cell").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    order = Window.partitionBy("parent").orderBy("cell")  # at most CELLS rows of a node
    apart = ~_equal(F.lag("b").over(order), F.lag("l").over(order), F.col("b"), F.col("l"))
    cells = cells.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0)))
    cells = cells.withColumn("class", F.sum("apart").over(order))
    whole = Window.partitionBy("parent", "class")
    classes = cells.select("parent", "cell", "class", F.sum("l").over(whole).alias("cl"), F.sum("b").over(whole).alias("cb"))

    share = (F.col("cb") + 1.0) / (F.col("cl") + 2.0)
    slack = BOUND * F.sqrt(share * (1.0 - share) / (F.col("cl") + 2.0))
    side = F.when(share + slack < 0.5, "[allow]").when(share - slack > 0.5, "[block]").otherwise("[mixed]")
    fits = F.abs(F.col("b") / F.col("l") - share) <= ALIKE * F.sqrt(share * (1.0 - share) / F.col("l"))
    name = F.when(F.col("variable"), "*").when(F.col("class").isNotNull() & fits, F.concat(side, F.col("class").cast("string"))).otherwise(F.col("segment"))
    named = children.join(nodes, "parent").join(classes, ["parent", "cell"], "left").select("parent", "segment", name.alias("name"))
    return levels.drop("name").join(named, ["parent", "segment"]).drop("parent")


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template, purity)."""
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({
        "rule": by_longest_rule(rules, F.col("host"), F.col("path"), lambda r: r.name),
        "ruled": by_longest_rule(rules, F.col("host"), F.col("path"), lambda r: r.verdict),
        "segments": F.filter(F.split(F.regexp_replace("path", "[0-9]+", "<n>"), "/"), lambda s: s != ""),
    })
    rows = rows.withColumn("shape", F.array_join("segments", "/"))

    labelled, blocked = F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")
    shapes = rows.groupBy("host", "shape").agg(F.first("segments").alias("segments"), F.count("*").alias("n"), labelled, blocked)
    shapes = written(shapes.withColumn("key", F.md5(F.concat_ws("/", "host", "shape"))), "shapes")

    total = shapes.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).first()  # one row
    share = (total.b or 0) / total.l if total.l else 0.0

    levels = shapes.select("key", F.xxhash64("host").alias("at"), "n", "labelled", "blocked", F.posexplode("segments").alias("level", "segment"))
    levels = levels.withColumn("name", F.col("segment"))
    for n in range(PASSES):
        levels = written(_merged(levels), f"levels{n}")
    paths = levels.groupBy("key")
    # as many names as the path has segments
    paths = paths.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]), "/").alias("template"))

    own = shapes.select("key", "host", "shape", "labelled", "blocked").join(paths, "key", "left").withColumn("template", F.coalesce("template", F.lit("")))
    by_template = own.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    by_shape = own.groupBy("shape").agg(((F.sum("blocked") + PRIOR * share) / (F.sum("labelled") + PRIOR)).alias("everywhere"))
    purity = (F.col("b") + PRIOR * F.col("everywhere")) / (F.col("l") + PRIOR)
    judged = own.select("host", "shape", "template").join(by_template, ["host", "template"]).join(by_shape, "shape")
    judged = judged.select("host", "shape", "template", purity.alias("purity"))

    out = rows.select("id", "host", "path", "rule", "ruled", "shape").join(judged, ["host", "shape"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def _sql_rule(value) -> str:
    cases = [
        f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{value(r)}'"
        for r in sorted(RULES, key=lambda r: -len(r.name))
    ]
    return "CASE " + " ".join(cases) + " END"


def _sql_pass(n: int) -> str:
    share, smooth = "((b1 + b2) / (l1 + l2))", "((cb + 1.0::DOUBLE) / (cl + 2.0::DOUBLE))"
    slack = f"{BOUND}::DOUBLE * sqrt({smooth} * (1.0::DOUBLE - {smooth}) / (cl + 2.0::DOUBLE))"
    return f"""), under{n} AS (
  SELECT *, coalesce(string_agg(name, '/') OVER (PARTITION BY host, shape ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent
  FROM levels{n}
), sums{n} AS (
  SELECT host, level, parent, segment, sum(n)::DOUBLE AS pages, sum(labelled)::DOUBLE AS l, sum(blocked)::DOUBLE AS b FROM under{n} GROUP BY ALL
), children{n} AS (
  SELECT *, CASE WHEN l >= {EVIDENCE} THEN floor((b + 1.0::DOUBLE) / (l + 2.0::DOUBLE) * {CELLS}) END AS cell FROM sums{n}
), nodes{n} AS (
  SELECT host, level, parent, sum(pages) AS every, count(*) AS kinds FROM children{n} GROUP BY ALL
), cells{n} AS (
  SELECT host, level, parent, cell, sum(l) AS l2, sum(b) AS b2 FROM children{n} WHERE cell IS NOT NULL GROUP BY ALL
), pairs{n} AS (
  SELECT *, lag(l2) OVER w AS l1, lag(b2) OVER w AS b1 FROM cells{n} WINDOW w AS (PARTITION BY host, level, parent ORDER BY cell)
), steps{n} AS (
  SELECT *, coalesce((NOT abs(b1 / l1 - b2 / l2) <= {ALIKE}::DOUBLE * sqrt({share} * (1.0::DOUBLE - {share}) * (1.0::DOUBLE / l1 + 1.0::DOUBLE / l2)))::INT, 0) AS apart
  FROM pairs{n}
), runs{n} AS (
  SELECT *, sum(apart) OVER (PARTITION BY host, level, parent ORDER BY cell) AS class FROM steps{n}
), classes{n} AS (
  SELECT host, level, parent, cell, class, sum(l2) OVER w AS cl, sum(b2) OVER w AS cb FROM runs{n} WINDOW w AS (PARTITION BY host, level, parent, class)
), named{n} AS (
  SELECT host, level, parent, segment, CASE WHEN every >= {VARIABLE_PAGES} AND kinds >= {VARIABLE_SHARE}::DOUBLE * every THEN '*'
    WHEN class IS NOT NULL AND abs(b / l - {smooth}) <= {ALIKE}::DOUBLE * sqrt({smooth} * (1.0::DOUBLE - {smooth}) / l)
    THEN CASE WHEN {smooth} + {slack} < 0.5::DOUBLE THEN '[allow]' WHEN {smooth} - {slack} > 0.5::DOUBLE THEN '[block]' ELSE '[mixed]' END || class::BIGINT
    ELSE segment END AS name
  FROM children{n} JOIN nodes{n} USING (host, level, parent) LEFT JOIN classes{n} USING (host, level, parent, cell)
), levels{n + 1} AS (
  SELECT u.* EXCLUDE (parent) REPLACE (m.name AS name) FROM under{n} u JOIN named{n} m USING (host, level, parent, segment)
"""


def _sql_passes() -> str:
    return "".join(map(_sql_pass, range(PASSES)))


SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), split AS (
  SELECT *, {_sql_rule(lambda r: r.name)} AS rule, {_sql_rule(lambda r: r.verdict)} AS ruled,
         list_filter(string_split(regexp_replace(path, '[0-9]+', '<n>', 'g'), '/'), lambda s: s <> '') AS s FROM parts
), shaped AS (
  SELECT page_id, host, path, rule, ruled, s AS segments FROM split
), rows_ AS (
  SELECT *, array_to_string(segments, '/') AS shape FROM shaped
), shapes AS (
  SELECT host, shape, first(segments) AS segments, count(*) AS n, count(ruled) AS labelled,
         count(*) FILTER (WHERE ruled = 'block') AS blocked FROM rows_ GROUP BY host, shape
), share AS (
  SELECT CASE WHEN sum(labelled) > 0 THEN sum(blocked)::DOUBLE / sum(labelled)::DOUBLE ELSE 0 END AS share FROM shapes
), levels0 AS (
  SELECT host, shape, n, labelled, blocked, u.level - 1 AS level, segments[u.level] AS segment, segments[u.level] AS name
  FROM shapes, unnest(range(1, len(segments) + 1)) AS u(level)
{_sql_passes()}), paths AS (
  SELECT host, shape, string_agg(name, '/' ORDER BY level) AS template FROM levels{PASSES} GROUP BY host, shape
), own AS (
  SELECT host, shape, labelled, blocked, coalesce(template, '') AS template FROM shapes LEFT JOIN paths USING (host, shape)
), by_template AS (
  SELECT host, template, sum(labelled)::DOUBLE AS l, sum(blocked)::DOUBLE AS b FROM own GROUP BY ALL
), by_shape AS (
  SELECT shape, (sum(blocked)::DOUBLE + {PRIOR}::DOUBLE * (SELECT share FROM share)) / (sum(labelled)::DOUBLE + {PRIOR}::DOUBLE) AS everywhere
  FROM own GROUP BY shape
), judged AS (
  SELECT host, shape, (b + {PRIOR}::DOUBLE * everywhere) / (l + {PRIOR}::DOUBLE) AS purity
  FROM own JOIN by_template USING (host, template) JOIN by_shape USING (shape)
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM rows_ LEFT JOIN judged USING (host, shape)
"""
