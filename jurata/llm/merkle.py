"""A Merkle manifest of a table, with a proof for every row.

A row's leaf is the digest of its fields. The leaves of a group, in the order of their key, are the bottom of a tree of
arity 3 whose root is the group's subroot; the subroots in the order of the groups are the bottom of the tree of the whole
table. Every node is kept as a row (tree, level, idx, digest).

A proof is made by looking coordinates up: from its index and the size of its group a leaf knows which siblings it needs on
each level, it is exploded to their coordinates, which are joined to the node table; siblings are put in order, joined to
one text a side and level, and folded. As all leaves below one node need the same siblings above it, a leaf explodes the
coordinates of the lowest STEP levels only, the nodes on top of those explode theirs for the next STEP levels, and so on:
about six coordinates a leaf at any size, and every key of every join has 27 rows at most, whatever the size of a group.

Nothing but the size of the largest group, and one row for each partition of the sort, comes to the driver.

Edge cases: null fields are `-` in a leaf; a null group is a group of its own and comes first, as a null key does in its
group; rows with one group and key (repeated rows) are leaves of their own, in the order of their digests; a group of one
row has its leaf as subroot, a single group's subroot is the root, a proof without siblings is the digest of an empty text;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import placed, table, written

ARITY = 3
#: Levels that are built, and exploded, together.
STEP = 3
SPAN = ARITY**STEP


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its length in bytes, a colon and its text, or `-` if it's null."""
    texts = [f.cast("string") for f in fields]
    return _digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return reduce(lambda a, level: a + (n > ARITY**level).cast("int"), range(39), F.lit(0))


def _above(nodes: Column) -> Column:
    """The nodes one level up."""
    run = lambda i: F.slice(nodes, i * ARITY + 1, F.lit(ARITY))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), lambda i: _digest(F.array_join(F.transform(run(i), _hex), "")))


class Forest:
    """Trees over items (tree, idx, n, height, digest): idx from 0 to n - 1 in each tree, height the levels above its items."""

    def __init__(self, items: DataFrame):
        #: Nodes of the levels 0, STEP, 2 * STEP ..., and all nodes of the levels from there to STEP levels up.
        self.items, self.nodes = [items], []
        highest = items.agg(F.max("height")).first()[0] or 0
        while True:
            base = len(self.nodes) * STEP
            self.nodes.append(self._built(self.items[-1], base))
            if highest < base + STEP:
                break
            self.items.append(self.nodes[-1].where(F.col("level") == base + STEP).drop("level"))

    @staticmethod
    def _built(items: DataFrame, base: int) -> DataFrame:
        runs = items.groupBy("tree", "n", "height", F.expr(f"idx div {SPAN}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))  # SPAN items at most
        runs = runs.select("tree", "n", "height", "block", F.transform("run", lambda x: x["digest"]).alias("x0"))
        for level in range(STEP):
            runs = runs.withColumn(f"x{level + 1}", F.when(F.col("height") > base + level, _above(F.col(f"x{level}"))).otherwise(F.array().cast("array<binary>")))
        row = lambda level: lambda x, i: F.struct(F.lit(base + level).alias("level"), (F.col("block") * ARITY ** (STEP - level) + i).alias("idx"), x.alias("digest"))
        found = runs.select("tree", "n", "height", F.explode(F.flatten(F.array(*[F.transform(f"x{level}", row(level)) for level in range(STEP + 1)]))).alias("x"))
        return written(found.select("tree", "n", "height", "x.level", "x.idx", "x.digest"), "nodes")

    def roots(self) -> DataFrame:
        """(tree, digest) of each tree's top."""
        tops = [x.where(F.col("level") == F.col("height")).where(F.lit(i == 0) | (F.col("level") > i * STEP)).select("tree", "digest") for i, x in enumerate(self.nodes)]
        return reduce(DataFrame.union, tops)

    def paths(self, above: DataFrame) -> DataFrame:
        """items with `steps`, the siblings on each side on each level from the item up, and the columns of `above` (tree, steps and others), whose steps follow."""
        others = [c for c in above.columns if c not in ("tree", "steps")]
        start = above.withColumn("idx", F.lit(-1).cast("long"))
        parents, out = start, None
        for i in reversed(range(len(self.nodes))):
            items, base = self.items[i], i * STEP
            high = F.col("height") >= base + STEP  # the tree goes on above these levels
            up = parents.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("steps").alias("_steps"), *others)
            key = F.when(high, F.expr(f"idx div {SPAN}")).otherwise(F.lit(-1))
            met = items.join(up, (items["tree"] == up["_tree"]) & (key == up["_idx"])).drop("_tree", "_idx")
            own = self._siblings(items, self.nodes[i], base)
            out = met.join(own, ["tree", "idx"], "left")
            found = F.coalesce("found", F.array().cast("array<struct<level:int,at:long,left:boolean,digest:string>>"))
            levels = F.least("height", F.lit(base + STEP))
            out = out.withColumn("found", found).withColumn("steps", F.concat(self._steps(base, levels), F.col("_steps"))).drop("found", "_steps")
            if i:
                parents = written(out.drop("n", "height", "digest"), "paths").unionByName(start)
        return out

    @staticmethod
    def _siblings(items: DataFrame, nodes: DataFrame, base: int) -> DataFrame:
        """(tree, idx, found): the siblings of each item on the levels from `base` on, in order, with the side they stand on."""
        last = F.least("height", F.lit(base + STEP)) - 1
        asked = items.where(last >= base).select("tree", "idx", "n", F.explode(F.sequence(F.lit(base), last)).alias("level"))
        power = F.element_at(F.array(*[F.lit(ARITY**k).cast("long") for k in range(STEP)]), F.col("level") - base + 1)
        size = F.element_at(F.array(*[F.expr(f"(n - 1) div {ARITY ** (base + k)} + 1") for k in range(STEP)]), F.col("level") - base + 1)
        asked = asked.select("tree", "idx", "level", power.alias("power"), size.alias("size"))
        asked = asked.withColumn("own", F.expr("idx div power")).withColumn("first", F.expr(f"own - own % {ARITY}"))
        asked = asked.select("tree", "idx", "level", "own", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ARITY - 1)), lambda j: F.col("first") + j)).alias("at")).where("at <> own and at < size")
        known = nodes.where(F.col("level") < base + STEP).select("tree", "level", F.col("idx").alias("at"), "digest")
        met = asked.join(known, ["tree", "level", "at"])
        return met.groupBy("tree", "idx").agg(F.array_sort(F.collect_list(F.struct("level", "at", (F.col("at") < F.col("own")).alias("left"), _hex(F.col("digest")).alias("digest")))).alias("found"))  # 2 * STEP at most

    @staticmethod
    def _steps(base: int, levels: Column) -> Column:
        """A struct of the siblings left and right for each level from base on, also where there are none."""
        side = lambda level, left: F.array_join(F.transform(F.filter("found", lambda s: (s["level"] == level) & (s["left"] == left)), lambda s: s["digest"]), "")
        steps = F.transform(F.sequence(F.lit(base), levels - 1), lambda level: F.struct(side(level, True).alias("left"), side(level, False).alias("right")))
        return F.when(levels > base, steps).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


def proof(steps: Column) -> Column:
    """The digests of all siblings, level by level, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf (hex) and its siblings give."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def proofs(rows: DataFrame) -> DataFrame:
    """rows (group, key, digest and others, which are kept) with steps, subroot and root (hex)."""
    rows = placed(written(rows, "rows"), ["group", "key", "digest"], "sorted")
    spans = rows.groupBy("part", "group").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    spans = written(spans, "spans")  # a row for each group and each partition it runs on into
    groups = written(placed(spans.groupBy("group").agg(F.min("first").alias("start"), F.sum("size").alias("n")), ["group"], "groups").select(F.col("group").alias("_group"), F.col("place").alias("tree"), "start", "n", _height(F.col("n")).alias("height")), "groups")
    spans = written(spans.join(groups, F.col("group").eqNullSafe(F.col("_group"))).select(F.col("part").alias("_part"), "_group", "tree", "start", "n", "height"), "spans")
    rows = rows.join(spans, (F.col("part") == F.col("_part")) & F.col("group").eqNullSafe(F.col("_group")))
    leaves = written(rows.withColumn("idx", F.col("place") - F.col("start")).drop("part", "_part", "_group", "place", "start"), "leaves")
    trees = Forest(leaves.select("tree", "idx", "n", "height", "digest"))
    trees.items[0] = leaves
    subroots = written(trees.roots(), "subroots")
    n = F.lit(subroots.count()).cast("long")
    top = Forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), n.alias("n"), _height(n).alias("height"), "digest"))
    none = F.array().cast("array<struct<left:string,right:string>>").alias("steps")
    ends = top.paths(top.roots().select("tree", none, _hex(F.col("digest")).alias("root")))
    above = written(ends.select(F.col("idx").alias("tree"), "steps", _hex(F.col("digest")).alias("subroot"), "root"), "above")
    return trees.paths(above)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    original = [F.col(c) for c in FIELDS]
    tampered = leaf(*original[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    other = F.when(F.coalesce(changed & F.contains("text", F.lit("\n")), F.lit(False)), tampered)
    rows = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf(*original).alias("digest"), other.alias("other"))
    found = proofs(rows)
    given = _hex(F.coalesce("other", "digest"))
    out = found.select(F.col("key").alias("doc_id"), _hex(F.col("digest")).alias("leaf"), "subroot", "root", F.sha2(proof(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), folded(given, F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen({0}::varchar), ':', {0}::varchar) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in FIELDS) + "))"
_TREE = """
{0}nodes(tree, level, idx, n, h) AS (SELECT tree, 0, idx, n, h FROM {0}leaves UNION ALL SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {0}nodes WHERE n > 1 GROUP BY tree, level, idx // 3, (n + 2) // 3),
{0}sides AS (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
    FROM {0}nodes a LEFT JOIN {0}nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3 AND a.idx <> b.idx WHERE a.n > 1 GROUP BY ALL),
"""
ORACLE = {
    "op13_merkle_manifest": f"""WITH RECURSIVE bits(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
given AS (SELECT *, {_LEAF} AS h, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 2 = 0 AS changed FROM documents, crcs),
changed AS (SELECT * REPLACE (CASE WHEN changed THEN replace(text, chr(10), '') ELSE text END AS text) FROM given),
leaves AS (SELECT doc_id, h, {_LEAF} AS other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM changed),
{_TREE.format("")}
topleaves AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, h FROM nodes WHERE n = 1),
{_TREE.format("top")}
walk(doc_id, leaf, tree, idx, level, pos, proof, node) AS (SELECT doc_id, h, tree, idx, 0, idx, '', other FROM leaves UNION ALL SELECT doc_id, leaf, w.tree, w.idx, w.level + 1, pos // 3, concat(proof, l, r), sha256(concat(l, node, r)) FROM walk w JOIN sides s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.pos),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY tree, idx ORDER BY level DESC) = 1),
topwalk(doc_id, leaf, tree, idx, level, pos, proof, node) AS (SELECT doc_id, leaf, tree, idx, 0, tree, proof, node FROM ends UNION ALL SELECT doc_id, leaf, w.tree, w.idx, w.level + 1, pos // 3, concat(proof, l, r), sha256(concat(l, node, r)) FROM topwalk w JOIN topsides s ON s.level = w.level AND s.idx = w.pos),
topends AS (SELECT * FROM topwalk QUALIFY row_number() OVER (PARTITION BY tree, idx ORDER BY level DESC) = 1)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t.h AS verified FROM topends w JOIN topleaves s ON s.idx = w.tree, topnodes t WHERE t.n = 1"""
}
