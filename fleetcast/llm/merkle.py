"""Merkle manifest of a dataset, kept as append logs in postorder.

Each group of rows is a tree: leaves in key order, every two consecutive nodes
of a level make their parent, a node left over alone makes one by itself, up
to a single node, the group's root. The roots, in group order, make one more
tree in the same way.

Leaves are dealt to builders in aligned blocks of ``2^bits``. A builder keeps
a stack of finished subtrees and writes each node when it is complete, which
is postorder. So no node needs an address of its own: before leaf ``s`` there
are ``2 s - ones(s)`` finished nodes, and a whole subtree of height ``h`` takes
``2^(h+1) - 1`` places. The nodes above the last leaf that aren't whole are
written last, level by level. Block roots are the leaves of the next tier.

A proof is read from the logs by these positions, tier by tier from the top;
the part above a block is common to its leaves. Texts are hashed where they
are read; only keys and digests are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.common import bounded_batches, materialize, table
from fleetcast.llm.numbering import numbered

BITS = 12                      # a builder's block has 2^BITS leaves at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MOD = 7
LEFT, RIGHT, ALONE = "L", "R", "-"     # where a step's sibling stands


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    return max(n - 1, 0).bit_length()


def place(h, i, n: int):
    """Position, in postorder, of node ``i`` of level ``h`` above ``n`` leaves."""
    i = np.asarray(i, np.int64)
    first = i << h
    whole = 2 * first - np.bitwise_count(first) + (2 << h) - 2
    tail = 2 * n - n.bit_count() + h - (n & -n).bit_length()
    return np.where((i + 1) << h <= n, whole, tail)


def append_log(leaves: list[str], top: int) -> tuple[list[str], list[int]]:
    """Digests and levels of all nodes up to level ``top``, in the order in
    which they are complete."""
    log, level, stack = [], [], []

    def write(h: int, digest: str) -> str:
        log.append(digest)
        level.append(h)
        return digest

    for i, leaf in enumerate(leaves):
        stack.append(write(0, leaf))
        h = 0
        while i >> h & 1:
            right, left = stack.pop(), stack.pop()
            h += 1
            stack.append(write(h, H(left, right)))
    n, last = len(leaves), None            # last: the node at the end of a level that isn't whole
    for h in range(top):
        left = [stack.pop()] if n >> h & 1 else []
        if left or last is not None:
            last = write(h + 1, H(*left, *([] if last is None else [last])))
    return log, level


def steps(log: np.ndarray, n: int, top: int) -> list[str]:
    """The path of each of ``n`` leaves to level ``top``: a letter and the
    sibling's digest for each level, or ``-`` where there is no sibling."""
    i, parts = np.arange(n), []
    for h in range(top):
        node = i >> h
        sibling = node ^ 1
        there = sibling < -(-n >> h)
        found = log[place(h, np.where(there, sibling, node), n)]
        parts.append([(LEFT if k & 1 else RIGHT) + s if t else ALONE for k, s, t in zip(node.tolist(), found.tolist(), there.tolist())])
    return ["".join(p) for p in zip(*parts)] if parts else [""] * n


def siblings(path: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(path):
        side = path[at]
        end = at + (1 if side == ALONE else 65)
        yield side, path[at + 1:end]
        at = end


def fold(leaf: str, path: str) -> str:
    """The root that ``leaf`` and the siblings of ``path`` lead to."""
    for side, other in siblings(path):
        leaf = H(other, leaf) if side == LEFT else H(leaf, other)
    return leaf


def row_digest(columns: list[Column]) -> Column:
    """sha256 over the values: ``-`` for null, else UTF-8 bytes, ``:``, value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def tree_key(group: str) -> Column:
    """Never null; ordered as the group, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))


@dataclass
class Tier:
    leaves: DataFrame          # tree, size (nodes of this level), pos, digest, block
    log: DataFrame             # tree, block, at (place in the block's log), place (in the whole tree's), level, digest


def _top(size: int, bits: int) -> int:
    """Levels that a block's builder adds: up to the root where it is alone."""
    return bits if size > 1 << bits else height(size)


def build(leaves: DataFrame, bits: int = BITS) -> tuple[list[Tier], DataFrame]:
    """The tiers of logs over ``leaves`` (tree, size, pos, digest), and the
    roots (tree, size, digest). Each tier is written once."""
    def builder(base: int):
        def write(group: pa.Table) -> pa.Table:
            group = group.sort_by("pos")
            size, block, leaf_count = (group[c][0].as_py() for c in ("size", "block", "leaf_count"))
            log, level = append_log(group["digest"].to_pylist(), _top(size, bits))
            level, n = np.array(level), len(log)
            where = np.zeros(n, np.int64)
            for h in range(level.max() + 1):
                at = np.flatnonzero(level == h)
                where[at] = place(base + h, (block << bits - h) + np.arange(len(at)), leaf_count)
            return pa.table({"tree": pa.array([group["tree"][0].as_py()] * n, pa.string()), "block": pa.array([block] * n, pa.int64()),
                             "at": pa.array(np.arange(n), pa.int64()), "place": pa.array(where, pa.int64()),
                             "level": pa.array(base + level, pa.int32()), "digest": pa.array(log, pa.string()),
                             "size": pa.array([size] * n, pa.int64()), "leaf_count": pa.array([leaf_count] * n, pa.int64()),
                             "top": pa.array(np.arange(n) == n - 1, pa.bool_())})       # a block's root is complete last

        return write

    tiers, roots, base = [], None, 0
    level = leaves.select("tree", "size", "pos", "digest", F.col("size").alias("leaf_count"))
    most = leaves.agg(F.max("size")).first()[0] or 0
    while True:
        level = level.withColumn("block", F.shiftright("pos", bits))
        log = materialize(level.groupBy("tree", "block").applyInArrow(
            builder(base), "tree string, block long, at long, place long, level int, digest string, size long, leaf_count long, top boolean"),
            "merkle-log")
        tiers.append(Tier(level, log))
        tops = log.filter("top")
        done = tops.filter(F.col("size") <= 1 << bits).select("tree", F.col("leaf_count").alias("size"), "digest")
        roots = done if roots is None else roots.unionByName(done)
        if most <= 1 << bits:
            return tiers, roots
        most, base = -(-most >> bits), base + bits
        level = materialize(tops.filter(F.col("size") > 1 << bits).select(
            "tree", F.expr(f"shiftright(size + {(1 << bits) - 1}, {bits})").alias("size"), F.col("block").alias("pos"), "digest", "leaf_count"),
            "merkle-level")


def extract(leaves: DataFrame, log: DataFrame, above: DataFrame, keep: list[str], bits: int) -> DataFrame:
    """``keep`` columns of the leaves, ``path`` to the root, and ``subroot`` and
    ``root``. ``above``: tree, block, and the path from the block's root on."""
    kinds = {f.name: f.dataType for f in leaves.schema.fields}
    left = leaves.select("tree", "block", "size", "pos", *[c for c in keep if c not in ("tree", "pos")])
    right = (log.select("tree", "block", "at", "digest", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
             .unionByName(above.select("tree", "block", F.lit(-1).cast("long").alias("at"), F.col("path").alias("digest"), "subroot", "root")))

    def read(group: pa.Table, nodes: pa.Table) -> pa.Table:
        group, nodes = group.sort_by("pos"), nodes.sort_by("at")
        log = np.array(nodes["digest"].to_pylist()[1:], object)
        n = len(group)
        size = group["size"][0].as_py() if n else 0
        tail, subroot, root = (nodes[c][0].as_py() for c in ("digest", "subroot", "root"))
        path = [p + tail for p in steps(log, n, _top(size, bits))]
        return pa.table({**{c: group[c] for c in keep}, "path": pa.array(path, pa.string()),
                         "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string())})

    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in keep) + ", path string, subroot string, root string"
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(read, schema)


def _paths(tiers: list[Tier], above: DataFrame, bits: int) -> DataFrame:
    """``tree``, ``block`` of the lowest tier and the path above it. ``above``:
    the path above the root of each tree."""
    up = None
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        alone = (tier.leaves.filter((F.col("size") <= 1 << bits) & (F.col("pos") == 0)).select("tree", "block")
                 .join(above, "tree").select("tree", "block", "path", "subroot", "root"))
        up = alone if up is None else alone.unionByName(up)
        if k:
            up = materialize(extract(tier.leaves, tier.log, up, ["tree", "pos"], bits).withColumnRenamed("pos", "block"), "merkle-paths")
    return up


def manifest(rows: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = FIELDS, group: str = "lang",
             altered: dict[str, Column] | None = None, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: the proofs, the logs of all groups, and the groups' roots.

    Proofs, one per row: ``key``, ``leaf``, ``presented`` (the leaf of the row
    with the columns of ``altered`` in place; equal to ``leaf`` without),
    ``path``, ``subroot``, ``root``. Logs: tree, place (in postorder), level,
    digest. Roots: tree, size, digest.

    Leaves are in order of the key, null first, then of their digest; rows that
    are equal in both each are a leaf. A null group is a group, before all
    others; null values count as such, and differ from empty texts. Other
    columns are ignored. An empty table gives empty results.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    altered = altered or {}
    digests = rows.select(F.col(key).alias("key"), tree_key(group).alias("tree"), row_digest([F.col(f) for f in fields]).alias("digest"),
                          row_digest([altered.get(f, F.col(f)) for f in fields]).alias("presented"))
    leaves = materialize(numbered(digests, ["key", "digest"]), "merkle-numbered")
    tiers, roots = build(leaves, bits)
    roots = materialize(roots, "merkle-roots")
    crown = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"])
    crown = materialize(crown, "merkle-crown")
    crown_tiers, crown_root = build(crown, bits)
    top = crown_root.select(F.lit("").alias("tree"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    crown_leaves = crown.withColumn("block", F.shiftright("pos", bits))
    above = extract(crown_leaves.withColumnRenamed("digest", "own"), crown_tiers[0].log, _paths(crown_tiers, top, bits), ["of", "own"], bits)
    above = materialize(above.select(F.col("of").alias("tree"), "path", F.col("own").alias("subroot"), "root"), "merkle-above")
    up = _paths(tiers, above, bits)
    proofs = extract(leaves.withColumn("block", F.shiftright("pos", bits)).withColumnRenamed("digest", "leaf"),
                     tiers[0].log, up, ["key", "leaf", "presented"], bits)
    log = tiers[0].log
    for k, tier in enumerate(tiers[1:], 1):
        log = log.unionByName(tier.log.filter(F.col("level") > k * bits))        # its leaves are in the tier below, too
    return proofs.withColumnRenamed("key", key), log.select("tree", "place", "level", "digest"), roots


def verify(proofs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of the
    siblings' digests along the path), ``folded_root`` (from ``presented``) and
    ``verified``. Repeated rows and null keys each give their row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            presented, path, root = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("presented", "path", "root"))
            proof = [H(*[s for _, s in siblings(p)]) for p in path]
            folded = [fold(leaf, p) for leaf, p in zip(presented, path)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in (key, "leaf", "subroot", "root")),
                 pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array([a == b for a, b in zip(folded, root)], pa.bool_())],
                names=[key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = proofs.schema[key].dataType.simpleString()
    return proofs.select(key, "leaf", "subroot", "root", "presented", "path").mapInArrow(
        run, f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every row's proof; rows whose id's crc32 is divisible by 7 are presented
    with one more character than they have."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPER_MOD == 0, F.col("n_chars").cast("decimal(20,0)") + 1)
    proofs, _, _ = manifest(docs, altered={"n_chars": F.coalesce(tampered, F.col("n_chars").cast("decimal(20,0)"))})
    return verify(proofs)


ORACLE = f"""
WITH RECURSIVE
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
field AS (SELECT documents.*, coalesce(strlen(CAST(documents.doc_id AS VARCHAR)) || ':' || documents.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail,
  n_chars + CASE WHEN crc % {TAMPER_MOD} = 0 THEN 1 ELSE 0 END AS changed FROM documents LEFT JOIN crc USING (doc_id)),
leaf AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(strlen(CAST(coalesce(changed, n_chars) AS VARCHAR)) || ':' || coalesce(changed, n_chars), '-') || tail) AS presented FROM field),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS who FROM leaf),
node AS (SELECT tree, 0 AS h, i, n, leaf AS d FROM numbered
  UNION ALL SELECT tree, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY tree, h, n, i // 2),
subroot AS (SELECT tree, d, h AS levels, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
crown AS (SELECT 0 AS h, i, n, d FROM subroot
  UNION ALL SELECT h + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY h, n, i // 2),
total AS (SELECT count(*) AS n, max(h) AS levels FROM crown),
sibling AS (
  SELECT l.who, g.h, l.i >> g.h AS i, o.d FROM (SELECT who, tree, numbered.i, levels FROM numbered JOIN subroot USING (tree)) AS l
    JOIN (SELECT unnest(range(64)) AS h) AS g ON g.h < l.levels LEFT JOIN node AS o ON o.tree = l.tree AND o.h = g.h AND o.i = xor(l.i >> g.h, 1)
  UNION ALL
  SELECT l.who, l.levels + g.h, l.i >> g.h, o.d FROM (SELECT who, subroot.i, levels FROM numbered JOIN subroot USING (tree)) AS l
    JOIN (SELECT unnest(range(64)) AS h) AS g ON g.h < (SELECT levels FROM total) LEFT JOIN crown AS o ON o.h = g.h AND o.i = xor(l.i >> g.h, 1)),
path AS (SELECT who, list(CASE WHEN d IS NULL THEN '-' WHEN i % 2 = 1 THEN 'L' || d ELSE 'R' || d END ORDER BY h) AS steps,
  coalesce(string_agg(d, '' ORDER BY h), '') AS proof FROM sibling GROUP BY who),
folded AS (SELECT doc_id, leaf, tree, coalesce(proof, '') AS proof, list_reduce(list_concat([presented], coalesce(steps, [])), lambda a, s:
    CASE WHEN s = '-' THEN sha256(a) WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS cur
  FROM numbered LEFT JOIN path USING (who))
SELECT doc_id, leaf, s.d AS subroot, c.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = c.d AS verified
FROM folded JOIN subroot AS s USING (tree) JOIN (SELECT d FROM crown WHERE n = 1) AS c ON true"""
