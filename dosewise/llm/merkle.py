"""Merkle manifest of a table with a proof for every row, found by pointer jumping.

Method. Each row is a leaf digest; the leaves of a language, in order of id, are the bottom of a tree in which eight
consecutive nodes make one; the languages' roots, in order of language, are the bottom of the tree above. Every node first
holds the segment of siblings towards its parent. Then the tables of nodes are joined with themselves again and again: the
segment towards an ancestor is followed by that ancestor's own segment, so the distance doubles each time, until every leaf
has reached the root. A row's proof is its list of segments; folding a leaf through it gives the root again.

Only built-in functions are used. Places in a tree come from a range partitioning on (language, id) and one running sum over
its partitions, so a language that holds most rows is spread over many tasks. A step of the self-join at distance d has at
most 8**d rows of one key and its other side is 8**d times smaller; that side is broadcast where its measured size allows it.

Nulls are written as ``-`` and differ from any text. A null id sorts first and is never tampered with; a null language is a
tree of its own, the first. Rows of equal language and id are leaves side by side, ordered by their digests, and repeated rows
are leaves of their own. Only the five columns are read, so other columns may have any names. An empty table gives an empty
result; a table of one row is its own root and has an empty proof.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dosewise.llm.common import documents
from dosewise.session import broadcast_rows, materialize

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a node table up to which it may be broadcast; a node's segments have some kilobytes.
BROADCAST_NODES = 50_000
PATH = "array<struct<before: binary, after: binary>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each with its length in bytes, as 32 bytes."""
    parts = []
    for field in fields:
        written = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def placed(rows: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ``at``, their place (from 0) in their group by ``order``, and ``size``, the group's rows.

    A range partitioning puts the rows in order; only the numbers of rows per group and partition are summed up. Rows of
    equal order are dealt over partitions too, as they are exchangeable.
    """
    keys = [group, *order]
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tie.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    stored = materialize(ranged.withColumn("_row", F.monotonically_increasing_id()), f"{name}-order")
    part = F.shiftright("_row", 33)
    counts = stored.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    )
    runs = counts.selectExpr(
        "_group",
        "_part",
        "sum(_n) over (partition by _group order by _part) - _n - _first as _shift",
        "sum(_n) over (partition by _group) as size",
    )
    runs = broadcast_rows(materialize(runs, f"{name}-runs"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part"))
    return stored.join(runs, same).withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_group", "_part", "_shift")


def tree_runs(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of siblings of all trees, one table per level, and the trees' tops, from leaves ``(tree, at, size, digest)``.

    A run is ``(tree, level, at, is_top, digests)``: the children, from the left, of node ``at`` of the level above
    ``level``; ``is_top`` says that this node is the tree's top. Tops are ``(tree, digest)``; a lone leaf is one itself.
    """
    runs, tops, nodes = [], leaves.filter("size = 1").select("tree", "digest"), leaves
    while True:
        above = (
            nodes.filter("size > 1")
            .groupBy("tree", F.expr(f"at div {ARITY}").alias("at"))
            .agg(
                F.max(F.expr(f"(size + {ARITY - 1}) div {ARITY}")).alias("size"),
                F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("_run"),
            )
            .select("tree", "at", "size", F.col("_run.digest").alias("digests"))
            .withColumn("digest", F.unhex(F.sha2(F.array_join(F.transform("digests", _hex), "").cast("binary"), 256)))
        )
        above = materialize(above, f"{name}-level{len(runs)}")
        if above.isEmpty():
            return runs, tops
        tops = tops.unionByName(above.filter("size = 1").select("tree", "digest"))
        runs.append(above.selectExpr("tree", f"{len(runs)} as level", "at", "size = 1 as is_top", "digests"))
        nodes = above.drop("digests")


def _node(tree: Column, level: Column, at: Column) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), at.cast("long").alias("at"))


def _step(digests: str, i: str) -> Column:
    """The siblings of child ``i`` of a run, to its left and right, each side's digests joined."""
    before = f"unhex(array_join(transform(slice({digests}, 1, cast({i} as int)), d -> hex(d)), ''))"
    after = f"unhex(array_join(transform(slice({digests}, cast({i} as int) + 2, {ARITY}), d -> hex(d)), ''))"
    return F.expr(f"struct({before} as before, {after} as after)")


def _parent(is_upper: bool) -> Column:
    """The node that a run belongs to. The upper tree is -1; a lower tree's top is the upper leaf of that tree's number."""
    inside = _node(F.col("tree"), F.col("level") + 1, F.col("at"))
    return inside if is_upper else F.when(F.col("is_top"), _node(F.lit(-1), F.lit(0), F.col("tree"))).otherwise(inside)


def first_segments(runs: DataFrame, is_upper: bool) -> DataFrame:
    """``(node, ancestor, path)`` of every child of a run: the path to its parent is one step."""
    child = runs.select("*", F.expr("explode(sequence(0, size(digests) - 1)) as i"))
    place = F.col("at") * ARITY + F.col("i")
    return child.select(
        _node(F.col("tree"), F.col("level"), place).alias("node"),
        _parent(is_upper).alias("ancestor"),
        F.array(_step("digests", "i")).alias("path"),
    )


def joined_paths(nodes: DataFrame, onto: DataFrame) -> DataFrame:
    """One self-join: each node's path followed by that of its ancestor, to whose ancestor it now points.

    Nodes that have reached the root stay as they are.
    """
    further = onto.select(F.col("node").alias("_node"), F.col("ancestor").alias("_ancestor"), F.col("path").alias("_path"))
    joined = nodes.join(broadcast_rows(further, BROADCAST_NODES), F.col("ancestor") == F.col("_node"), "left")
    return joined.select(
        *[c for c in nodes.columns if c not in ("ancestor", "path")],
        F.coalesce("_ancestor", "ancestor").alias("ancestor"),
        F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path")).alias("path"),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its path, as hex text."""

    def step(digest: Column, s: Column) -> Column:
        return F.sha2(F.concat(_hex(s["before"]), digest, _hex(s["after"])).cast("binary"), 256)

    return F.aggregate(path, _hex(leaf), step)


def manifest(docs: DataFrame, tampered: Column | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """``(id, leaf, changed, subroot, root, path)`` of every row; digests are of 32 bytes.

    ``fields`` names id, source, language, length and text. ``changed`` is the leaf with ``tampered`` for its text, the same
    leaf where that is null.
    """
    id, source, lang, n_chars, text = (F.col(f"`{f}`") for f in fields)
    leaf = leaf_digest(id, source, lang, n_chars, text)
    other = F.lit(None).cast("binary")
    if tampered is not None:
        other = F.when(tampered.isNotNull(), leaf_digest(id, source, lang, n_chars, tampered))
    rows = docs.select(id.alias("id"), lang.alias("lang"), leaf.alias("leaf"), other.alias("other"))
    leaves = placed(materialize(rows, "merkle-rows"), "lang", ["id", "leaf"], "merkle-leaves")

    # The languages are put in order, and so numbered, in the same way.
    names = leaves.filter("at = 0").select(F.lit(0).alias("one"), "lang")
    trees = placed(names, "one", ["lang"], "merkle-trees").selectExpr("lang as _lang", "at as tree", "size as n_trees")
    trees = broadcast_rows(materialize(trees, "merkle-numbers"))
    numbered = leaves.join(trees, F.col("lang").eqNullSafe(F.col("_lang"))).drop("lang", "_lang")
    leaves = materialize(numbered, "merkle-placed")

    lower, tops = tree_runs(leaves.selectExpr("tree", "at", "size", "leaf as digest"), "merkle-lower")
    tops = materialize(tops, "merkle-subroots")
    bottom = tops.selectExpr("-1L as tree", "tree as at", "digest").withColumn("size", F.lit(tops.count()))
    upper, top = tree_runs(bottom, "merkle-upper")
    root = top.first()

    # Each leaf begins with its siblings; inner nodes' segments are tables of their own, an eighth as large.
    walking = leaves.withColumn("level", F.lit(0))
    step = F.array(_step("digests", f"at % {ARITY}"))
    if lower:
        runs = lower[0].selectExpr("tree as _tree", "at as _at", "is_top", "digests")
        walking = walking.join(runs, F.expr(f"tree = _tree and at div {ARITY} = _at"), "left")
        parent = _node(F.col("tree"), F.lit(1), F.col("_at"))
        parent = F.when(F.col("is_top") | F.col("digests").isNull(), _node(F.lit(-1), F.lit(0), F.col("tree"))).otherwise(parent)
        path = F.when(F.col("digests").isNotNull(), step).otherwise(F.array().cast(PATH))
    else:
        parent, path = _node(F.lit(-1), F.lit(0), F.col("tree")), F.array().cast(PATH)
    walking = walking.select("tree", "id", "leaf", "other", parent.alias("ancestor"), path.alias("path"))
    depth = max(1, len(lower)) + len(upper)
    inner = reduce(
        DataFrame.unionByName,
        [first_segments(r, False) for r in lower[1:]] + [first_segments(r, True) for r in upper],
    ) if depth > 1 else None
    distance = 1
    while distance < depth:
        inner = materialize(inner, f"merkle-segments{distance}")
        walking = joined_paths(walking, inner)
        distance *= 2
        # Lower nodes below this distance are no leaf's ancestors any more.
        inner = joined_paths(inner.filter((F.col("node.tree") < 0) | (F.col("node.level") >= distance)), inner)
    subroots = broadcast_rows(tops.withColumnsRenamed({"tree": "_tree", "digest": "subroot"}))
    return walking.join(subroots, F.col("tree") == F.col("_tree")).select(
        "id", "leaf", F.coalesce("other", "leaf").alias("changed"), "subroot",
        F.lit(root["digest"] if root else None).cast("binary").alias("root"), "path",
    )


def proof_digest(path: Column) -> Column:
    """SHA-256, as hex text, of all siblings of a path in order."""
    siblings = F.transform(path, lambda s: F.concat(_hex(s["before"]), _hex(s["after"])))
    return F.sha2(F.array_join(siblings, "").cast("binary"), 256)


def op13_pointer_proofs(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and the root that a changed or unchanged leaf gives with it."""
    docs = documents(spark, sf_dir)
    changed = F.when(
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & F.col("text").isNotNull(),
        F.translate("text", _UPPER, _LOWER),
    )
    found = manifest(docs, changed).withColumn("folded_root", folded(F.col("changed"), F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"),
        *[_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == _hex(F.col("root"))).alias("verified"),
    )


def _sql_digest(text: str) -> str:
    fields = [f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(fields)})"


#: Levels are made by recursion; a row's place at each level follows from its place in its language by division by 8.
OP13_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {_sql_digest('text')} AS leaf,
         CASE WHEN crc % 3 = 0 THEN {_sql_digest("translate(text, '" + _UPPER + "', '" + _LOWER + "')")} ELSE NULL END AS other
  FROM (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1),
          lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
          lambda crc, b: list_reduce([xor(crc, b)] || range(1, 9)::BIGINT[],
            lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) AS crc
        FROM documents)),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM docs),
lower_nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(size) + 7) // 8
  FROM lower_nodes WHERE size > 1 GROUP BY tree, pos // 8),
subroots AS (SELECT tree, level AS height, digest FROM lower_nodes WHERE size = 1),
upper_nodes AS (
  SELECT 0 AS level, tree AS pos, digest, count(*) OVER () AS size FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(size) + 7) // 8
  FROM upper_nodes WHERE size > 1 GROUP BY pos // 8),
runs AS (
  SELECT n.tree, n.level, n.pos // 8 AS run, list(n.digest ORDER BY n.pos) AS ds FROM lower_nodes n WHERE n.size > 1 GROUP BY ALL
  UNION ALL
  SELECT -1, level, pos // 8, list(digest ORDER BY pos) FROM upper_nodes WHERE size > 1 GROUP BY ALL),
walk AS (
  SELECT l.tree AS lang_no, l.pos AS leaf_pos, 0 AS step, 0 AS level, s.height,
         CASE WHEN s.height = 0 THEN -1 ELSE l.tree END AS tree, CASE WHEN s.height = 0 THEN l.tree ELSE l.pos END AS pos,
         '' AS proof, coalesce(l.other, l.leaf) AS folded
  FROM leaves l JOIN subroots s ON l.tree = s.tree
  UNION ALL
  SELECT lang_no, leaf_pos, step + 1, CASE WHEN is_top THEN 0 ELSE level + 1 END, height,
         CASE WHEN is_top THEN -1 ELSE tree END, CASE WHEN is_top THEN lang_no ELSE pos // 8 END,
         proof || array_to_string(ds[1 : pos % 8], '') || array_to_string(ds[pos % 8 + 2 :], ''),
         sha256(array_to_string(ds[1 : pos % 8], '') || folded || array_to_string(ds[pos % 8 + 2 :], ''))
  FROM (SELECT w.*, r.ds, w.tree >= 0 AND w.level + 1 = w.height AS is_top
        FROM walk w JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.pos // 8)),
done AS (SELECT lang_no, leaf_pos, arg_max(proof, step) AS proof, arg_max(folded, step) AS folded FROM walk GROUP BY ALL)
SELECT l.doc_id, l.leaf, s.digest AS subroot, u.digest AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root,
       d.folded = u.digest AS verified
FROM leaves l JOIN subroots s ON l.tree = s.tree JOIN upper_nodes u ON u.size = 1
JOIN done d ON d.lang_no = l.tree AND d.leaf_pos = l.pos
"""
