"""Merkle manifest of a table: a tree for each source, one over the sources, and a proof for every row.

A leaf is a row's digest; every 16 consecutive nodes become the digest of their hex texts joined, until one is left. Rows
are numbered within their source and dealt into superblocks of 16 ** 3 leaves, whole subtrees. Superblocks are reduced
first, which gives the outer nodes; these are joined level by level, and the paths go down again from the roots, so that
a join never meets more than 16 children a node. In the end a superblock's leaves and the outer nodes that its proofs
require are cogrouped; one function finishes the local reduction, joins the proofs and folds them.

A group holds at most 4,096 leaf digests and the outer nodes of one path, whatever a source's size; texts are hashed
by the JVM before any shuffle and never move. Only the number of levels and the root itself reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ranks import running_sum
from strandloom.session import materialize

FAN = 16
BLOCK_LEVELS = 3
BLOCK = FAN**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def joined_digest(nodes: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def levels_of(n: int) -> int:
    """How often ``n`` nodes are reduced until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**replaced: Column) -> Column:
    """The digest of a row's fields, each as its UTF-8 size, ``:`` and value, or ``-`` if null."""
    return F.sha2(F.concat(*(_field(replaced.get(name, F.col(name))) for name in FIELDS)).cast("binary"), 256)


def _reduced(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """All levels of a superblock's subtree, leaves first."""
    tree = [leaves]
    for _ in range(levels):
        nodes = tree[-1]
        tree.append([joined_digest(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
    return tree


def _local_levels(n: int) -> int:
    return min(BLOCK_LEVELS, levels_of(n))


def _block_root(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("rank")
    n = int(group["n"].iloc[0])
    top = _reduced([x.encode() for x in group["leaf"]], _local_levels(n))[-1][0]
    return pd.DataFrame({"tree": group["tree"].iloc[:1], "idx": group["block"].iloc[:1], "m": [-(-n // BLOCK)], "node": [top.decode()]})


def _climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs (tree, run, nodes) of each level above ``nodes`` (tree, idx, m nodes of the tree, node), and the roots (tree, node)."""
    levels, roots = [], nodes.where("m = 1").select("tree", "node")
    for _ in range(levels_of(most)):
        runs = nodes.where("m > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("run"), F.expr(f"(m + {FAN - 1}) div {FAN}").alias("m"))
        runs = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).getField("node").alias("nodes"))
        levels.append(materialize(runs, "merkle-runs"))
        nodes = levels[-1].select("tree", F.col("run").alias("idx"), "m", F.sha2(F.array_join("nodes", "").cast("binary"), 256).alias("node"))
        roots = roots.unionByName(nodes.where("m = 1").select("tree", "node"))
    return levels, materialize(roots, "merkle-roots")


def _descend(levels: list[DataFrame], roots: DataFrame, in_source: bool) -> DataFrame:
    """(tree, idx, path) of the nodes below ``levels``; ``roots`` (tree, path) have the path from their own node upwards.

    A tree enters at the level where its last run stands; a path's steps go upwards, each a place and the run's nodes.
    """
    above = roots.select("tree", F.lit(0).cast("long").alias("idx"), "path")
    for runs in reversed(levels):
        step = F.struct(F.lit(in_source).alias("in_source"), F.col("place"), F.col("nodes"))
        met = runs.withColumnRenamed("run", "idx").join(above, ["tree", "idx"])
        below = met.select("tree", "idx", "nodes", "path", F.posexplode("nodes").alias("place", "node"))
        below = below.select("tree", (F.col("idx") * FAN + F.col("place")).alias("idx"), F.concat(F.array(step), "path").alias("path"))
        # trees that end below this level have no run here and wait
        waiting = above.join(met.select("tree").distinct(), "tree", "left_anti")
        above = materialize(below.unionByName(waiting), "merkle-paths")
    return above


def _outer_nodes(bases: DataFrame, sources: int, most: int) -> tuple[DataFrame, str]:
    """(tree, block, step, in_source, place, at, node) for all steps above each superblock, and the root."""
    levels, subroots = _climb(bases, -(-most // BLOCK))
    forest = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(sources).cast("long").alias("m"), "node")
    upper, top = _climb(forest, sources)
    root = top.first()["node"]
    start = top.select("tree", F.expr("cast(array() AS array<struct<in_source boolean, place int, nodes array<string>>>)").alias("path"))
    paths = _descend(upper, start, False).select(F.col("idx").alias("tree"), "path")
    paths = _descend(levels, paths, True).select("tree", F.col("idx").alias("block"), F.posexplode("path").alias("step", "x"))
    return paths.select("tree", "block", "step", "x.in_source", "x.place", F.posexplode("x.nodes").alias("at", "node")), root


def _finish(leaves: pd.DataFrame, outer: pd.DataFrame, root: str) -> pd.DataFrame:
    """A superblock's rows: local reduction, siblings joined with the outer nodes, and the fold of each leaf."""
    leaves = leaves.sort_values("rank")
    own = [x.encode() for x in leaves["leaf"]]
    tree = _reduced(own, _local_levels(int(leaves["n"].iloc[0]))) if own else [[]]
    steps = []  # (before, after, whether within the source) above the superblock
    for _, run in outer.sort_values(["step", "at"]).groupby("step"):
        place, nodes = int(run["place"].iloc[0]), [x.encode() for x in run["node"]]
        steps.append((b"".join(nodes[:place]), b"".join(nodes[place + 1 :]), bool(run["in_source"].iloc[0])))
    tail = b"".join(before + after for before, after, _ in steps)
    subroot = tree[-1][0] if own else b""
    for before, after, in_source in steps:
        subroot = joined_digest((before, subroot, after)) if in_source else subroot

    runs = [[b"".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)] for nodes in tree[:-1]]
    rows = []
    for k, (leaf, told) in enumerate(zip(own, leaves["tampered"], strict=True)):
        proof, node, at = hashlib.sha256(), leaf if told is None else told.encode(), k
        for level in runs:
            run, place = level[at // FAN], at % FAN * 64
            before, after = run[:place], run[place + 64 :]
            proof.update(before + after)
            node, at = joined_digest((before, node, after)), at // FAN
        proof.update(tail)
        for before, after, _ in steps:
            node = joined_digest((before, node, after))
        rows.append((proof.hexdigest(), node.decode()))
    out = pd.DataFrame({"doc_id": leaves["doc_id"].array, "leaf": leaves["leaf"].array, "subroot": subroot.decode(), "root": root})
    out["proof_sha256"], out["folded_root"] = [r[0] for r in rows], [r[1] for r in rows]
    out["verified"] = out["folded_root"] == root
    return out


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    ``tampered`` is the text that a row is verified with; null, or the text itself, leaves the row as it is. Defined
    results: nulls count as ``-``; a null doc_id comes first in its source, a null source first of all; rows that repeat an id
    are ordered by their leaf, equal rows stand side by side; an empty table gives no rows; a source of one row is its
    own subroot, and the only source's subroot is the root. Columns besides ``FIELDS`` are not read.
    """
    changed = F.lit(None).cast("string") if tampered is None else tampered
    other = F.when(changed != F.coalesce(F.col("text"), F.lit("")), leaf_digest(text=changed))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), leaf_digest().alias("leaf"), other.alias("tampered"))
    leaves = materialize(leaves, "merkle-leaves")
    sizes = leaves.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("forest", F.lit(0))
    sizes = materialize(running_sum(sizes, "forest", "source", column="tree").select(F.col("source").alias("of_source"), "n", "tree"), "merkle-sources")
    told = sizes.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("most")).first()
    if not told["sources"]:
        return docs.sparkSession.createDataFrame([], RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))
    ranked = running_sum(leaves, "source", "doc_id", "leaf", column="rank")
    placed = ranked.join(sizes, F.col("source").eqNullSafe(F.col("of_source"))).select("tree", "n", "rank", F.expr(f"rank div {BLOCK}").alias("block"), F.col("doc_id").cast("string").alias("doc_id"), "leaf", "tampered")
    placed = materialize(placed, "merkle-placed")
    bases = placed.select("tree", "block", "n", "rank", "leaf").groupBy("tree", "block").applyInPandas(_block_root, "tree long, idx long, m long, node string")
    outer, root = _outer_nodes(materialize(bases, "merkle-bases"), told["sources"], told["most"])
    pairs = placed.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    # ids travel as text: pandas would make numbers with nulls among them floats
    return pairs.applyInPandas(lambda left, right: _finish(left, right, root), RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))


def lowered(one_in: int = 5) -> Column:
    """The text with A-Z lower-cased where ``one_in`` divides the unsigned crc32 of the decimal doc_id, else null."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % one_in == 0, lower)


def oracle(levels: int = 6) -> str:
    """SQL of ``manifest(docs, lowered(5))``, for sources and numbers of sources up to 16 ** ``levels``."""

    def tree(name: str, leaves: str) -> str:
        """Tables {name}_k (tree, i, h, m) of each level, {name}_runs_k (tree, run, hs) and {name}_top (tree, h)."""
        sql = [f"{name}_0 AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS m FROM ({leaves}))"]
        for k in range(levels):
            sql.append(f"{name}_runs_{k} AS (SELECT tree, i // {FAN} AS run, max(m) AS m, list(h ORDER BY i) AS hs FROM {name}_{k} WHERE m > 1 GROUP BY ALL)")
            sql.append(f"{name}_{k + 1} AS (SELECT tree, run AS i, sha256(array_to_string(hs, '')) AS h, (m + {FAN - 1}) // {FAN} AS m FROM {name}_runs_{k})")
        tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}_{k} WHERE m = 1" for k in range(levels + 1))
        return ",\n".join([*sql, f"{name}_top AS ({tops})"])

    def fold(name: str, table: str, at: str) -> str:
        """``table`` with proof and folded carried up ``name``'s tree from place ``at``."""
        sql = []
        for k in range(levels):
            place = f"({at} // {FAN**k} % {FAN})"
            kept = f"hs[:{place}]", f"hs[{place} + 2:]"
            sql.append(f"""{name}_fold_{k + 1} AS (SELECT t.* REPLACE (
                CASE WHEN hs IS NULL THEN proof ELSE proof || array_to_string({kept[0]} || {kept[1]}, '') END AS proof,
                CASE WHEN hs IS NULL THEN folded ELSE sha256(array_to_string({kept[0]} || [folded] || {kept[1]}, '')) END AS folded)
                FROM {table} t LEFT JOIN {name}_runs_{k} r ON r.tree = t.{'source_no' if name == 'own' else 'forest'} AND r.run = {at} // {FAN ** (k + 1)})""")
            table = f"{name}_fold_{k + 1}"
        return ",\n".join(sql)

    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({f})::VARCHAR)) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"

    # crc32 bit by bit over the id's characters
    step = "list_reduce(list_concat([xor(c, ascii(d)::BIGINT)], range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: {step.replace('ascii(d)::BIGINT', 'd')}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH docs AS (SELECT doc_id, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS folded,
                             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS source_no, source FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, 0 AS forest, '' AS proof FROM docs),
        {tree("own", "SELECT source_no AS tree, i, leaf AS h FROM placed")},
        {tree("all", "SELECT 0 AS tree, tree AS i, h FROM own_top")},
        {fold("own", "placed", "i")},
        {fold("all", f"own_fold_{levels}", "source_no")}
        SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
        FROM all_fold_{levels} f JOIN own_top s ON s.tree = f.source_no JOIN all_top r ON r.tree = f.forest"""
