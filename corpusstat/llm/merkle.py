"""Merkle manifest of a dataset: a tree of SHA-256 digests per group, a tree over the groups' roots, and each row's path to the root.

Rows get their places by ranges (ranks.py); from there on all is arithmetic on places: nodes i*fanout to i*fanout+fanout-1 of a level meet in one group of at most
`fanout` rows, whose sorted digests are hashed into node i of the next level. Paths are passed down from the root, one join a level between nodes and their
parents, so no key of a join holds more than `fanout` rows, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusstat.llm.blocks import Scratch
from corpusstat.llm.ranks import running

FANOUT = 8
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def leaf(*fields: Column) -> Column:
    """The digest of a row: of each field `-` if null, else the number of its UTF-8 bytes, a colon and the field (numbers in decimal)."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in shown)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof(path: Column) -> Column:
    """The siblings of all levels in one string, from the leaf's to the root's, each level left to right."""
    return F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"])))


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level of nodes (grp, i, n, digest, ...), for the groups that have more than one node."""
    children = F.transform(F.sort_array(F.collect_list(F.struct("i", "digest"))), lambda c: c["digest"])
    runs = nodes.where("n > 1").groupBy("grp", F.expr(f"i div {fanout}").alias("i")).agg(F.first("n").alias("n"), children.alias("children"))
    return runs.select("grp", "i", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), "children", F.sha2(F.concat_ws("", "children"), 256).alias("digest"))


def tree(tables: Scratch, nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """All levels above `nodes`, lowest first, until every group has one node. The driver reads one number a level."""
    levels: list[DataFrame] = []
    widest = nodes.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        levels.append(tables.write(f"{name}-{len(levels) + 1}", parents(levels[-1] if levels else nodes, fanout)))
        widest = -(-widest // fanout)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The one node that remains of each group, of whatever level."""
    found = [level.where("n = 1").select("grp", "digest") for level in (nodes, *levels)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def descend(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """nodes with their path. above has (grp, subroot, root, path) for the top of each group."""
    lists = (*levels[::-1], nodes)
    known = None
    for level in lists:
        own = level.where("n = 1").join(above, level["grp"].eqNullSafe(above["top"])).drop("top")
        if known is not None:
            up = known.select(F.col("grp").alias("_g"), F.col("i").alias("_i"), F.col("children").alias("_children"), "subroot", "root", "path")
            rest = level.where("n > 1").withColumn("_i", F.expr(f"i div {fanout}"))
            on = rest["grp"].eqNullSafe(up["_g"]) & (rest["_i"] == up["_i"])
            at = (F.col("i") % fanout).cast("int")
            step = F.struct(F.concat_ws("", F.slice("_children", F.lit(1), at)).alias("left"), F.concat_ws("", F.slice("_children", at + 2, F.lit(fanout))).alias("right"))
            joined = rest.join(up, on).withColumn("path", F.concat(F.array(step), "path"))
            own = own.select(*level.columns, "subroot", "root", "path").unionByName(joined.select(*level.columns, "subroot", "root", "path"))
        known = own
    return known


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = FANOUT, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: `order` and `group`, place (from 0, within its group), leaf, subroot (its group's), root, path, and the columns of `keep`.

    Leaves ascend by `order` within a group, nulls first, and by their digests where it ties. While more than one node of a group remains, every `fanout`
    consecutive ones (the last run may be shorter, even one) become the digest of theirs. The groups' remaining nodes, ordered by group (null first, then
    by UTF-8 bytes), give the root in the same way. A path has a step for each level, from the leaf's to the root's: the digests of the run to the left and to
    the right of the node. Repeated rows are leaves of their own; a null group is a group; texts of any length are digested whole; no rows give no
    rows, and have no root. Columns that aren't named are ignored, so others may be called anything."""
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    tables = Scratch(docs.sparkSession, "merkle")
    keep = keep or {}
    rows = docs.select(F.col(group).alias("grp"), F.col(order).alias("ord"), leaf(*map(F.col, fields)).alias("digest"), F.struct(*(c.alias(k) for k, c in keep.items()), F.lit(0).alias("_")).alias("kept"))
    rows = tables.write("leaves", rows)
    ones = {"rows": F.lit(1).cast("long")}
    placed = running(tables, rows, ["grp"], ["ord", "digest"], ones)
    nodes = tables.write("nodes", placed.withColumnsRenamed({"before_rows": "i", "all_rows": "n"}))
    tables.drop("leaves", "ranged")
    levels = tree(tables, nodes.select("grp", "i", "n", "digest"), fanout, "level")

    heads = tables.write("subroots", tops(nodes, levels).withColumn("whole", F.lit(0)))
    order_heads = running(tables, heads, ["whole"], ["grp"], ones).withColumnsRenamed({"grp": "of", "whole": "grp", "before_rows": "i", "all_rows": "n"})
    upper = tables.write("upper", order_heads)
    over = tree(tables, upper.select("grp", "i", "n", "digest"), fanout, "over")
    start = tops(upper, over).select(F.col("grp").alias("top"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    group_paths = tables.write("group-paths", descend(upper, over, start, fanout).select(F.col("of").alias("top"), F.col("digest").alias("subroot"), "root", "path"))
    out = descend(nodes, levels, group_paths, fanout)
    return out.select(F.col("ord").alias(order), F.col("grp").alias(group), F.col("i").alias("place"), F.col("digest").alias("leaf"), "subroot", "root", "path", *(F.col(f"kept.{k}").alias(k) for k in keep))


def verify(found: DataFrame, changed: str) -> DataFrame:
    """found (of manifest()) with folded_root, worked out from the column `changed` where it isn't null and from the leaf elsewhere, and whether it is the root."""
    folded = found.withColumn("folded_root", fold(F.coalesce(F.col(changed), F.col("leaf")), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def sql(levels: int = 9, over: int = 5) -> str:
    """DuckDB SQL for op12: one step for each level, enough for fanout**levels rows in a language and fanout**over languages. crc32 is worked out bit by bit."""
    same = "lang IS NOT DISTINCT FROM"
    crc = ("xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), "
           "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, CAST(4294967295 AS BIGINT)), 4294967295)")  # fmt: skip
    field = lambda f: f"coalesce(CAST(octet_length(encode(CAST({f} AS VARCHAR))) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')"
    head = " || ".join(map(field, FIELDS[:-1]))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"d AS MATERIALIZED (SELECT doc_id, lang, sha256({head} || {field('text')}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {field(lower)}) END AS changed FROM documents)",
             "l0 AS MATERIALIZED (SELECT doc_id, changed, lang, leaf AS digest, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)"]
    grow = lambda name, k: f"{name}{k + 1} AS MATERIALIZED (SELECT lang, i // 8 AS i, any_value((n + 7) // 8) AS n, list(digest ORDER BY i) AS c, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM {name}{k} WHERE n > 1 GROUP BY lang, i // 8)"
    steps += [grow("l", k) for k in range(levels)]
    steps.append("r AS (" + " UNION ALL ".join(f"SELECT lang, digest FROM l{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    steps.append("u0 AS MATERIALIZED (SELECT lang AS of, NULL AS lang, digest, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM r)")
    steps += [grow("u", k) for k in range(over)]
    steps.append("w AS (" + " UNION ALL ".join(f"SELECT digest AS root FROM u{k} WHERE n = 1" for k in range(over + 1)) + ")")
    steps.append("p0 AS (SELECT doc_id, l0.lang AS lang, l0.digest AS leaf, u0.digest AS subroot, root, coalesce(changed, l0.digest) AS folded, '' AS proof, l0.i AS i, u0.i AS j FROM l0 JOIN u0 ON l0.lang IS NOT DISTINCT FROM u0.of CROSS JOIN w)")
    at = 0
    for name, place, count in (("l", "i", levels), ("u", "j", over)):
        for k in range(count):
            left, right = f"coalesce(array_to_string(c[1:CAST(p.{place} // {8**k} % 8 AS INT)], ''), '')", f"coalesce(array_to_string(c[CAST(p.{place} // {8**k} % 8 AS INT) + 2:8], ''), '')"
            on = f"x.{same} p.lang AND" if name == "l" else ""
            steps.append(f"p{at + 1} AS (SELECT doc_id, p.lang AS lang, leaf, subroot, root, CASE WHEN c IS NULL THEN folded ELSE sha256({left} || folded || {right}) END AS folded, proof || {left} || {right} AS proof, p.i AS i, p.j AS j FROM p{at} AS p LEFT JOIN {name}{k + 1} AS x ON {on} x.i = p.{place} // {8 ** (k + 1)})")
            at += 1
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM p{at}"
