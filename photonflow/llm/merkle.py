"""Merkle manifests: a hash tree over each group's rows and one over the groups, built level by level with lag and lead columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from photonflow.llm.common import cut, numbered, unused

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node.
ARITY = 16
PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value as text."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def _runs(nodes: DataFrame) -> DataFrame:
    """nodes (grp, pos, n, node) with up (the parent's place), left and right: the siblings before and after.

    A run is a parent's children, so no window holds more rows than that; lags reach back by the slot, leads on by the run's length.
    """
    slot = F.col("pos") % ARITY
    length = F.least(F.lit(ARITY).cast("long"), F.col("n") - F.col("pos") + slot)
    w = Window.partitionBy("grp", "up").orderBy("pos")
    nodes = nodes.withColumn("up", F.expr(f"pos div {ARITY}"))
    before = {f"_lag{j}": F.when(slot >= j, F.lag("node", j).over(w)) for j in range(ARITY - 1, 0, -1)}
    after = {f"_lead{j}": F.when(slot + j < length, F.lead("node", j).over(w)) for j in range(1, ARITY)}
    return nodes.withColumns(before | after).withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)}).drop(*before, *after)


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above: first children hash their runs."""
    first = _runs(nodes.where("n > 1")).where(F.col("pos") % ARITY == 0)
    return first.select("grp", F.col("up").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), F.sha2(F.concat("node", "right"), 256).alias("node"))


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of all levels, nodes first, and each group's last node (grp, node)."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    levels = [nodes]
    while most > 1:
        levels.append(cut(_parents(levels[-1]), "level"))
        most = -(-most // ARITY)
    tops = [level.where("n = 1").select("grp", "node") for level in levels]
    last = tops[0]
    for t in tops[1:]:
        last = last.unionByName(t)
    return levels, last


def _paths(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """levels[0] with path and what roots has: siblings from the node's own level up to the group's last node, then the group's own
    path. roots: grp, path and more, one row a group. Each level's joins hold its rows alone, a sixteenth of those of the one below."""
    more = [c for c in roots.columns if c not in ("grp", "path")]
    above = None
    for level in reversed(levels):
        alone = level.where("n = 1").join(roots, "grp")
        if above is not None:
            here = _runs(level.where("n > 1")).join(above, ["grp", "up"])
            here = here.withColumn("path", F.concat(F.array(F.struct("left", "right")), "path")).select(*alone.columns)
            alone = alone.unionByName(here)
        found = alone
        above = found.select("grp", F.col("pos").alias("up"), "path", *more)
    return found


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group_col: str = "source", id_col: str = "doc_id", also: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, path, and the columns of `also` (by name, over docs).

    A leaf is the digest of its fields, nulls told from empty texts. In each group leaves ascend by id (nulls first; rows of one id
    by leaf, so that equal rows may stand either way), 16 consecutive nodes make a parent, and the last run may be shorter; a lone leaf is its
    group's subroot. Subroots, by group (null first, UTF-8 bytes ascending), make the root likewise. path holds what
    folded() needs: an array of (left, right) siblings, digests concatenated, from the leaf's level to the root. An empty table
    gives no rows and has no root. Columns that are not named are not read; a text is hashed once, however long.

    Rows are numbered by ranges and windows hold one run of 16, so a group may hold most rows, and there may be as many groups as rows.
    """
    also = also or {}
    named = {unused(docs, f"_{name}_also"): name for name in also}
    kind = dict(docs.dtypes)[id_col]
    group = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("g"), group), F.lit("")).alias("grp"),
        leaf([F.col(f"`{f}`") for f in fields]).alias("node"), *(also[name].alias(own) for own, name in named.items()),
    )
    placed = cut(numbered(cut(rows, "leaves"), "grp", "id", "node", out="pos"), "leaves")
    sizes = cut(placed.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    levels, last = _levels(placed.join(sizes, "grp"))
    last = cut(last, "subroots")
    tops, root = _levels(cut(numbered(last.withColumn("all", F.lit("")), "all", "grp", out="pos").select(F.col("grp").alias("of"), F.col("all").alias("grp"), "pos", "node", F.lit(last.count()).cast("long").alias("n")), "subroots"))
    found = root.first()
    whole = docs.sparkSession.createDataFrame([("", [], found["node"] if found else None)], f"grp string, path {PATH}, root string")
    roots = cut(_paths(tops, whole).select(F.col("of").alias("grp"), F.col("node").alias("subroot"), "root", "path"), "roots")
    out = _paths(levels, roots)
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", *(F.col(own).alias(name) for own, name in named.items()))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of docs held against docs of which every fifth has its text's A-Z lowered: proofs of changed texts fail."""
    changed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.when(changed & (text != F.col("text")), leaf([text if f == "text" else F.col(f) for f in FIELDS]))
    found = manifest(docs, also={"other": other})
    end = folded(F.coalesce("other", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), end.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The tree by recursion over levels, then every leaf folded up along it. CRC-32 is taken bit by bit.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents),
e AS (SELECT doc_id, source,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(other) || ':' || other, '-') AS tail2 FROM d),
l AS (SELECT doc_id, sha256(head || tail) AS leaf, sha256(head || tail2) AS leaf2, coalesce('g' || source, '') AS grp FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM l),
t AS (SELECT grp, 0 AS level, pos, n, leaf AS node FROM n UNION ALL
  SELECT grp, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY grp, level, pos // 16, n),
s AS (SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, pos, n, node FROM s UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 16, n),
whole AS (SELECT grp, level, pos, n, node, 0 AS part FROM t UNION ALL SELECT '', level, pos, n, node, 1 FROM u),
w AS (SELECT *, list(node) OVER (PARTITION BY part, grp, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM whole),
p AS (SELECT part, grp, level, pos, array_to_string(run[:pos % 16], '') AS lefts, array_to_string(run[pos % 16 + 2:], '') AS rights FROM w WHERE n > 1),
f AS (SELECT doc_id, grp, 0 AS part, 0 AS level, pos, n, leaf2 AS node, '' AS proof FROM n UNION ALL
  SELECT f.doc_id, CASE WHEN f.n > 1 THEN f.grp ELSE '' END, CASE WHEN f.n > 1 THEN f.part ELSE 1 END, CASE WHEN f.n > 1 THEN f.level + 1 ELSE 0 END,
    CASE WHEN f.n > 1 THEN f.pos // 16 ELSE s.pos END, CASE WHEN f.n > 1 THEN (f.n + 15) // 16 ELSE s.n END,
    CASE WHEN f.n > 1 THEN sha256(p.lefts || f.node || p.rights) ELSE f.node END, CASE WHEN f.n > 1 THEN f.proof || p.lefts || p.rights ELSE f.proof END
  FROM f LEFT JOIN p ON p.part = f.part AND p.grp = f.grp AND p.level = f.level AND p.pos = f.pos LEFT JOIN s ON s.grp = f.grp AND f.part = 0 WHERE f.n > 1 OR f.part = 0)
SELECT f.doc_id, n.leaf, s.node AS subroot, (SELECT node FROM u WHERE n = 1) AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = (SELECT node FROM u WHERE n = 1) AS verified
FROM f JOIN n USING (doc_id) JOIN s ON s.grp = n.grp WHERE f.part = 1 AND f.n = 1
"""
