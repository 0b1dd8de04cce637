"""Prefix trie of conversations (operator 11) by whole-sequence collapse.

Conversations that share their beginnings share work and tokens.  The trie's nodes are the distinct beginnings, and no node
is walked to from another: everything is a join or a sum over rows (sequence, depth).

* A turn is reduced to a digest of its role and text and its word count; texts travel no further.
* Every beginning has a 128-bit name: the exclusive or of hashes of (place, digest), so names follow from running sums and
  the name of the parent from taking the last turn out again.
* Identical conversations collapse into one weighted sequence with a list of its ends; only the sequence's smallest member
  goes on.  Sequences that are proper beginnings of others are taken away by an anti-join; what stays are the leaves.
* Weighted beginnings add up to nodes.  A node belongs to its smallest member, which then owns all nodes of its own
  sequence from there down.  So the sums over a node's subtree are sums, over the sequences through it, of what each owns
  from that depth on: a running sum along the sequence and one aggregate.

Running sums go block by block (``BLOCK`` turns, then the totals of blocks), all joins on a conversation are on
(conversation, block), and end lists are hashed in chunks, so neither a conversation with most of the turns, nor a
beginning or an end shared by most conversations, is ever gathered in a task.

Null roles and texts are empty.  Turns of one number lie in the order of their digests, null numbers first; repeated rows are
turns of their own.  Rows with a null conv_id are a conversation without a shared head, whose id comes last when the smallest
member is sought and is written as an empty text, first, in a list of ends.  An empty table has no nodes, not even a root.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortframe.llm.common import crc_fold, join_hot, stored
from cohortframe.operators.ranking import ranked

BLOCK = 4096            # turns of a conversation that are summed at once
CHUNK = 4096            # ends that are written out at once
HEADS = 4               # a conversation takes over crc32(conv_id) % HEADS turns
FAMILY = 20             # from conversation conv_id - conv_id % FAMILY
NODE = ["depth", "k1", "k2"]


def _meet(a: DataFrame, b: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Join on columns that may be null; those of ``a`` stay."""
    other = b.select(*[F.col(c).alias(f"_{c}") if c in columns else c for c in b.columns])
    on = F.lit(True)
    for c in columns:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(other, on, how).drop(*[f"_{c}" for c in columns])


def digests(convs: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words, role, text`` of every row, nulls of role and text as empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return convs.select(F.col("conv_id").cast("long"), "turn", F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
                        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), role.alias("role"), text.alias("text"))


def rebuilt(convs: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """All conversations (``conv_id``) and the turns ``conv_id, pos, digest, words`` of the rebuilt ones, pos from 1.

    A conversation takes over the first h turns of the first of its family, h = crc32(conv_id) % heads, in place of its own first h.
    """
    own = stored(ranked(stored(digests(convs).drop("role", "text"), "turns"), ["turn", "digest"], by=["conv_id"], name="pos", total="n"), "ranked")
    convs = own.where("pos = 1").select("conv_id", "n", crc_fold("conv_id", heads).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = convs.where("base = conv_id").select("base", F.col("n").alias("n_base"))
    taken = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    head = own.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    first = taken.where("m > 0").join(head, "base").where("pos <= m").select("conv_id", "pos", "digest", "words")
    # where the family's first is too short, later turns move up
    moved = taken.where("m < h AND n > h").select("conv_id", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BLOCK))).alias("block"))
    tail = own.where(F.col("pos") > crc_fold("conv_id", heads)).withColumn("block", F.floor(F.col("pos") / BLOCK))
    rest = _meet(tail, moved, ["conv_id", "block"], "left").select(
        "conv_id", F.coalesce(F.col("pos") - crc_fold("conv_id", heads) + F.col("m"), "pos").alias("pos"), "digest", "words")
    return convs.select("conv_id"), first.unionByName(rest)


def _beginnings(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, depth, block, k1, k2, t1, t2, digest, words``: every beginning of every conversation, the empty one too."""
    hashed = turns.withColumns({"depth": F.col("pos").cast("long"), "block": F.floor((F.col("pos") - 1) / BLOCK)}).select(
        "conv_id", "depth", "block", F.xxhash64("depth", "digest").alias("t1"), F.xxhash64("digest", "depth", F.lit(1)).alias("t2"), "digest", "words")
    upto = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = stored(hashed.select("*", F.bit_xor("t1").over(upto).alias("x1"), F.bit_xor("t2").over(upto).alias("x2")), "beginnings")
    # the last row of a full block tells the block's sum; a row per BLOCK turns of a long conversation
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    full = inside.where(F.col("depth") % BLOCK == 0).select(
        "conv_id", (F.col("block") + 1).alias("block"), F.bit_xor("x1").over(before).alias("o1"), F.bit_xor("x2").over(before).alias("o2"))
    named = _meet(inside, full, ["conv_id", "block"], "left").select(
        "conv_id", "depth", F.floor(F.col("depth") / BLOCK).alias("block"), F.col("x1").bitwiseXOR(F.coalesce("o1", F.lit(0))).alias("k1"),
        F.col("x2").bitwiseXOR(F.coalesce("o2", F.lit(0))).alias("k2"), "t1", "t2", "digest", "words")
    zero = F.lit(0).cast("long")
    return named.unionByName(convs.select("conv_id", *[zero.alias(c) for c in ("depth", "block", "k1", "k2", "t1", "t2")],
                                          F.lit(None).cast("string").alias("digest"), zero.alias("words")))


def end_lists(members: DataFrame, by: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """``by`` and the SHA-256 of the group's ``conv_id`` in ascending order, comma-joined.

    Ids are ranked and written out chunk by chunk; lists of several chunks are hashed as a stream, in bounded memory.
    """
    by = list(by)
    placed = ranked(members.select(*by, "conv_id"), ["conv_id"], by=by, name="i", total="size")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("s")))), lambda x: x["s"]), ",")
    chunks = stored(placed.groupBy(*by, "size", F.floor((F.col("i") - 1) / chunk).alias("chunk")).agg(said.alias("said")), "ends")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for frame in frames:
            out = []
            for *now, said in frame[[*by, "said"]].itertuples(index=False, name=None):
                if now != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(said.encode())
            yield pd.DataFrame(out, columns=[*by, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*by, "ends_sha256"])

    many = chunks.where(F.col("size") > chunk).repartition(*by).sortWithinPartitions(*by, "chunk").drop("size")
    return chunks.where(F.col("size") <= chunk).select(*by, F.sha2("said", 256).alias("ends_sha256")).unionByName(
        many.mapInPandas(hashed, ", ".join(f"{c} long" for c in by) + ", ends_sha256 string"))


def _below(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """Per node the sums of ``cost`` and ``leaf`` over its subtree, from ``rows`` (conv_id, depth, block, k1, k2) and what each sequence owns."""
    paid = _meet(rows, owned, ["conv_id", "depth"], "left").select(
        "conv_id", *NODE, "block", F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    down = W.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    inside = stored(paid.select("conv_id", *NODE, "block", F.sum("cost").over(down).alias("cost"), F.sum("leaf").over(down).alias("leaf")), "below")
    after = W.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, 0)
    later = inside.where((F.col("depth") % BLOCK == 0) & (F.col("block") > 0)).select(
        "conv_id", (F.col("block") - 1).alias("block"), F.sum("cost").over(after).alias("more"), F.sum("leaf").over(after).alias("leaves"))
    whole = _meet(inside, later, ["conv_id", "block"], "left")
    return whole.groupBy(*NODE).agg(F.sum(F.col("cost") + F.coalesce("more", F.lit(0))).alias("saved_tokens"),
                                    F.sum(F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"))


def trie(convs: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` and
    ``last_turn``, the digest of its last turn (``with_texts`` tells what was said)."""
    ids, turns = rebuilt(convs, family, heads)
    every = _beginnings(ids, turns)
    members = stored(every.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by(F.struct("k1", "k2"), "depth").alias("k")).select("conv_id", "depth", "k.*"), "members")
    sequences = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"))
    kept = sequences.select("conv_id", "weight", F.col("depth").alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("depth") / BLOCK))).alias("block"))
    rows = stored(_meet(every, kept, ["conv_id", "block"], "inner").select("conv_id", "block", *NODE, "t1", "t2", "digest", "words", "weight", "length"), "rows")
    proper = rows.where("depth < length").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select(*NODE, F.lit(1).cast("long").alias("leaf"))
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.any_value("words").alias("words"),
                                    F.any_value("t1").alias("t1"), F.any_value("t2").alias("t2"), F.any_value("digest").alias("last_turn"))
    up = {"up_depth": F.col("depth") - 1, "up1": F.col("k1").bitwiseXOR(F.col("t1")), "up2": F.col("k2").bitwiseXOR(F.col("t2")),
          "cost": (F.col("n_convs") - 1) * F.col("words")}
    nodes = stored(nodes.join(leaves, NODE, "left").withColumns(up).drop("t1", "t2", "words"), "nodes")
    sums = _below(rows.select("conv_id", *NODE, "block"), nodes.select("conv_id", "depth", "cost", "leaf"))
    children = nodes.where("depth > 0").groupBy("up_depth", "up1", "up2").agg(F.count(F.lit(1)).alias("n_children"))
    family_of = children.select(*[F.col(a).alias(b) for a, b in zip(("up_depth", "up1", "up2"), NODE)], "n_children")
    parents = nodes.select(*[F.col(b).alias(a) for a, b in zip(("up_depth", "up1", "up2"), NODE)], F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(sums, NODE).join(family_of, NODE, "left").join(end_lists(members, NODE), NODE, "left")
    out = join_hot(stored(told.drop("cost", "leaf"), "told"), parents, ["up_depth", "up1", "up2"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "last_turn")


def with_texts(nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """Adds ``role`` and ``text`` of each node's last turn; both null at the root."""
    said = digests(convs).groupBy("digest").agg(F.any_value("role").alias("role"), F.any_value("text").alias("text")).withColumnRenamed("digest", "last_turn")
    return join_hot(nodes, said, ["last_turn"])


ORACLE = r"""
WITH RECURSIVE
bits AS (SELECT range AS b, range AS v, 0 AS k FROM range(256)
         UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL SELECT conv_id, s, i + 1, xor(crc.v >> 8, bits.v) FROM crc JOIN bits ON k = 8 AND b = xor(crc.v & 255, ascii(s[i + 1])) WHERE i < length(s)),
heads AS (SELECT conv_id, xor(v, 4294967295) % 4 AS h FROM crc WHERE i = length(s)),
said AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations),
words AS (SELECT digest, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words FROM said GROUP BY digest),
own AS (SELECT conv_id, list(digest ORDER BY turn NULLS FIRST, digest) AS seq FROM said GROUP BY conv_id),
whole AS (SELECT o.conv_id, coalesce(b.seq[1:h], []) || o.seq[h + 1:] AS seq FROM own o JOIN heads p ON o.conv_id IS NOT DISTINCT FROM p.conv_id
          LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
rows AS (SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq FROM whole),
nodes AS (SELECT depth, seq[1:depth] AS name, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(coalesce(CAST(conv_id AS VARCHAR), ''), ',' ORDER BY conv_id NULLS FIRST) FILTER (len(seq) = depth), '')) AS ends_sha256
          FROM rows GROUP BY 1, 2),
priced AS (SELECT n.*, (n_convs - 1) * coalesce(words, 0) AS cost FROM nodes n LEFT JOIN words w ON w.digest = n.name[depth]),
kids AS (SELECT name[1:depth - 1] AS name, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
up AS (SELECT q.name[1:q.d] AS name, sum(cost) AS saved_tokens, sum(CASE WHEN k.name IS NULL THEN 1 ELSE 0 END) AS n_leaves
       FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM priced) q LEFT JOIN kids k ON k.name = q.name GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN up u ON u.name = n.name LEFT JOIN kids k ON k.name = n.name LEFT JOIN nodes p ON n.depth > 0 AND p.name = n.name[1:n.depth - 1]
"""
