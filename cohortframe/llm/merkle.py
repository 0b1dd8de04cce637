"""Merkle manifest of a table (operator 13), checkpoint and recompute; DataFrame functions only.

Every row is a leaf; the leaves of a part (a language), in order, are hashed two by two up to the part's subroot, and the
subroots in order up to the root.  The last run of a level may be a single node, which is hashed alone.

* Only every ``stride``-th level is stored, as blocks of ``2 ** stride`` neighbours: a block holds the leaves of one
  aligned subtree and a task needs nothing else to hash it up.  The levels between are never written.
* Proofs go down the stored levels.  A block meets the path of its subtree's top (one row against one row, so no part is
  hot), makes its missing levels anew from the stored nodes, hands every node its siblings and forgets the levels.
* Leaves get their places by a distributed rank, so a part that holds most rows lies in as many tasks as it needs.

Null values are written ``-``; a null part comes first and is a part like any other.  Rows with one doc_id lie in the order
of their digests, null doc_ids before all others; rows that repeat entirely are leaves of their own.  An empty table has no
root and no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortframe.llm.common import crc_fold, stored
from cohortframe.operators.ranking import ranked

STRIDE = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _said(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: list[Column]) -> Column:
    """SHA-256 in lower-case hex of the values, each with its length before it."""
    return F.sha2(F.concat(*[_said(v) for v in values]), 256)


def _part(value: Column) -> Column:
    """A text that sorts like the value, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _height(n: str) -> Column:
    return F.when(F.col(n) <= 1, F.lit(0)).otherwise(F.length(F.bin(F.col(n) - 1)))


def _steps(level: int, stride: int) -> Column:
    """How many levels above ``level`` a block of its part has inside itself."""
    return F.least(F.greatest(_height("n") - level, F.lit(0)), F.lit(stride))


def _halved(nodes: str) -> str:
    return f"transform(sequence(0, (size({nodes}) + 1) div 2 - 1), i -> sha2(concat(get({nodes}, int(2 * i)), coalesce(get({nodes}, int(2 * i + 1)), '')), 256))"


def _with_levels(blocks: DataFrame, level: int, stride: int, upto: int) -> DataFrame:
    """Adds ``steps`` and the block's own levels ``l0 .. l<upto>`` above its stored nodes."""
    out = blocks.withColumns({"steps": _steps(level, stride), "l0": F.col("nodes")})
    for j in range(upto):
        out = out.selectExpr("*", f"if(steps > {j}, {_halved(f'l{j}')}, l{j}) AS l{j + 1}")
    return out


@dataclass(frozen=True)
class Tree:
    """Stored levels (``part, n, block, nodes``, at the lowest also ``rows``) and the top of each part (``part, n, top``)."""
    levels: list[DataFrame]
    tops: DataFrame
    stride: int


def build(leaves: DataFrame, stride: int = STRIDE) -> Tree:
    """From ``part, pos, n, node, row``: the place of a leaf in its part, the part's leaves, its digest and what goes with it."""
    block = F.floor(F.col("pos") / (1 << stride)).alias("block")
    at = F.sort_array(F.collect_list(F.struct("pos", "node", "row")))
    blocks = leaves.groupBy("part", "n", block).agg(at.alias("at")).select(
        "part", "n", "block", F.col("at.node").alias("nodes"), F.col("at.row").alias("rows"))
    levels, level = [], 0
    while True:
        levels.append(stored(blocks, f"merkle-{level}"))
        tops = _with_levels(levels[-1].select("part", "n", "block", "nodes"), level, stride, stride).select(
            "part", "n", F.col("block").alias("pos"), F.get(f"l{stride}", F.lit(0)).alias("node"))
        level += stride
        # one number; every part is a single node from its own height on
        if (levels[-1].agg(F.max(_height("n")).alias("h")).first()["h"] or 0) <= level:
            return Tree(levels, tops.select("part", "n", F.col("node").alias("top")), stride)
        blocks = tops.groupBy("part", "n", block).agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("at")).select(
            "part", "n", "block", F.col("at.node").alias("nodes"))


def proofs(tree: Tree, tops: DataFrame) -> DataFrame:
    """``part, n, pos, node, row, path`` and the other columns of ``tops`` for every leaf.

    ``tops``: a row per part with ``part``, the ``path`` above its top and whatever its leaves should carry.  A path lists the
    sibling at every level, an empty text where a node is alone, upwards.
    """
    carried = [c for c in tops.columns if c not in ("part", "path")]
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    for k in reversed(range(len(tree.levels))):
        full = _with_levels(tree.levels[k], k * tree.stride, tree.stride, tree.stride - 1)
        met = full.join(above.withColumnRenamed("pos", "block").withColumnRenamed("path", "upper"), ["part", "block"])
        siblings = ", ".join(f"coalesce(get(l{j}, int(shiftright(i, {j}) ^ 1)), '')" for j in range(tree.stride))
        row = ", 'row', get(rows, i)" if k == 0 else ""
        node = f"named_struct('pos', block * {1 << tree.stride} + i, 'node', x, 'own', slice(array({siblings}), 1, steps){row})"
        below = met.select("part", "n", *carried, "upper", F.expr(f"inline(transform(nodes, (x, i) -> {node}))"))
        above = below.select("part", *(["n", "node", "row"] if k == 0 else []), "pos", *carried, F.concat("own", "upper").alias("path"))
    return above


def fold(leaf: Column, path: Column, bits: Column) -> Column:
    """The root that follows from a leaf, its path and its place (a bit per level: 1, the leaf is on the right side)."""
    def up(state: Column, sibling: Column) -> Column:
        h = state["h"]
        right = state["b"].bitwiseAND(F.lit(1)) == 1
        return F.struct(F.sha2(F.when(right, F.concat(sibling, h)).otherwise(F.concat(h, sibling)), 256).alias("h"), F.shiftright(state["b"], 1).alias("b"))

    return F.aggregate(path, F.struct(leaf.alias("h"), bits.cast("long").alias("b")), up, lambda state: state["h"])


def manifest(leaves: DataFrame, order: list[str], stride: int = STRIDE) -> DataFrame:
    """From ``part, leaf`` and other columns: these, ``subroot, root, path`` and ``bits`` (as ``fold`` wants them) per leaf.

    ``leaves`` is read several times and should be stored.
    """
    row = F.struct(*[c for c in leaves.columns if c not in ("part", "leaf")])
    placed = ranked(leaves, [*order, "leaf"], by=["part"], name="pos", total="n")
    tree = build(placed.select("part", (F.col("pos") - 1).alias("pos"), "n", F.col("leaf").alias("node"), row.alias("row")), stride)
    subroots = ranked(tree.tops.select("part", "top"), ["part"], name="pos", total="n")
    upper = build(subroots.select(F.lit("").alias("part"), (F.col("pos") - 1).alias("pos"), "n", F.col("top").alias("node"), F.struct("part").alias("row")), stride)
    root = upper.tops.select("part", F.col("top").alias("root"), F.array().cast("array<string>").alias("path"))
    parts = proofs(upper, root).select(F.col("row.part").alias("part"), F.col("node").alias("subroot"), "root", "path", F.col("pos").alias("place"))
    bits = F.col("pos") + F.col("place") * F.pow(F.lit(2.0), _height("n")).cast("long")
    return proofs(tree, parts).select("row.*", F.col("node").alias("leaf"), "subroot", "root", "path", bits.alias("bits"))


def document_manifest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """The manifest of ``documents`` by language, with ``changed``: the leaf after tampering, null for the rows it spares.

    Where 7 divides crc32 of the doc_id, tampering adds 1 to n_chars; rows without a doc_id are spared.
    """
    values = {f: F.col(f) for f in FIELDS}
    hit = F.col("doc_id").isNotNull() & F.col("n_chars").isNotNull() & (crc_fold("doc_id", 7) == 0)
    leaves = docs.select("doc_id", _part(F.col("lang")).alias("part"), digest(list(values.values())).alias("leaf"),
                         F.when(hit, digest(list((values | {"n_chars": F.col("n_chars") + 1}).values()))).alias("changed"))
    return manifest(stored(leaves, "leaves"), ["doc_id"], stride)


def verified(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """One row per row: leaf, roots, digest of the proof, and whether the row as tampered still leads to the root."""
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"), F.col("bits"))
    return document_manifest(docs, stride).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE
bits AS (SELECT range AS b, range AS v, 0 AS k FROM range(256)
         UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
        UNION ALL SELECT doc_id, s, i + 1, xor(crc.v >> 8, bits.v) FROM crc JOIN bits ON k = 8 AND b = xor(crc.v & 255, ascii(s[i + 1])) WHERE i < length(s)),
hit AS (SELECT doc_id FROM crc WHERE i = length(s) AND xor(v, 4294967295) % 7 = 0),
said AS (SELECT doc_id, coalesce('=' || lang, '') AS part,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
leaves AS (SELECT doc_id, part, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                  CASE WHEN doc_id IN (SELECT doc_id FROM hit) AND n_chars IS NOT NULL
                       THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS changed FROM said),
placed AS (SELECT *, row_number() OVER (ORDER BY part, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
lev AS (SELECT part, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY part
        UNION ALL SELECT part, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM lev WHERE len(nodes) > 1),
tops AS (SELECT part, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY part) - 1 AS place FROM lev WHERE len(nodes) = 1),
up AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM tops
       UNION ALL SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM up WHERE len(nodes) > 1),
steps AS (SELECT id, lev.level AS level, pos >> lev.level AS spot, nodes FROM placed JOIN tops USING (part) JOIN lev USING (part) WHERE lev.level < height
          UNION ALL SELECT id, height + up.level, place >> up.level, nodes FROM placed JOIN tops USING (part), up WHERE len(nodes) > 1),
path AS (SELECT id, list(coalesce(nodes[xor(spot, 1) + 1], '') ORDER BY level) AS path, list(spot & 1 ORDER BY level) AS side FROM steps GROUP BY id),
fold AS (SELECT id, 0 AS k, coalesce(changed, leaf) AS h FROM placed
         UNION ALL SELECT id, k + 1, sha256(CASE WHEN side[k + 1] = 1 THEN path[k + 1] || h ELSE h || path[k + 1] END) FROM fold JOIN path USING (id) WHERE k < len(path)),
ends AS (SELECT id, max_by(h, k) AS folded_root FROM fold GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(path, ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN tops USING (part) JOIN ends USING (id) LEFT JOIN path USING (id), (SELECT nodes[1] AS root FROM up WHERE len(nodes) = 1)
"""
