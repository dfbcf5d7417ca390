"""A Merkle manifest of a table: hash trees that are built and changed block by block.

Every row is a leaf. The leaves of a group are a binary tree, and the roots of all groups are the
leaves of another. Trees are cut into aligned blocks of 2^10 nodes: a task gets the nodes of one block,
builds what is above them and keeps, for each, the path to the block's root. The roots of the
blocks are the nodes of the next round, so no task holds more than a block.

A tree is persistent. A changed leaf makes a version that copies the nodes from the leaf to the
root and shares all others with the first version. The task of the block copies the ancestors
within it; versions then go on as rows, each joined with the path of its block's root.
"""

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from antecede.operators.ranks import range_buckets, rank_within
from antecede.session import written

#: Levels of a block.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a node meets on its way up, a step for each level: the digest to its left or to its right, or neither.
_PATH = "array<struct<left:string,right:string>>"


def leaf_digest(columns: Iterable[Column]) -> Column:
    """sha256 in hex of the values in a row: ``-`` for null, else byte count, ``:`` and the text."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def build_block(digests: list[str], levels: int) -> tuple[list[list[dict[str, str]]], str]:
    """The path of every node of a block, ``levels`` steps each, and the node they all lead to."""
    paths: list[list[dict[str, str]]] = [[] for _ in digests]
    now = digests
    for level in range(levels):
        for i, path in enumerate(paths):
            at = i >> level
            left = now[at - 1] if at & 1 else ""
            right = now[at + 1] if not at & 1 and at + 1 < len(now) else ""
            path.append({"left": left, "right": right})
        now = [_hash(*now[i : i + 2]) for i in range(0, len(now), 2)]
    return paths, now[0]


def copy_path(changed: str, path: list[dict[str, str]]) -> list[str]:
    """The ancestors that a version copies: a changed node, hashed up a path."""
    copies = []
    for step in path:
        changed = _hash(step["left"], changed, step["right"])
        copies.append(changed)
    return copies


def _block(rows: pa.Table, bits: int) -> pa.Table:
    rows = rows.sort_by("pos")
    levels = min(bits, (rows.column("total")[0].as_py() - 1).bit_length())
    paths, top = build_block(rows.column("digest").to_pylist(), levels)
    steps = pa.struct([("left", pa.string()), ("right", pa.string())])
    tops = [top] + [None] * (len(paths) - 1)
    out = rows.append_column("path", pa.array(paths, pa.list_(steps))).append_column("top", pa.array(tops, pa.string()))
    if "changed" in rows.column_names:
        new = [None if c is None else copy_path(c, p) for c, p in zip(rows.column("changed").to_pylist(), paths)]
        out = out.append_column("copies", pa.array(new, pa.list_(pa.string())))
    return out


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of blocks over (tree, pos, digest, total), until every tree has one node left.

    Each round has its rows with their ``path`` in the block; the first row of a block also has its
    ``top``, and rows with a ``changed`` digest the ``copies`` of their ancestors.
    """
    rounds, bits = [], BITS
    while True:
        extra = ", copies array<string>" if "changed" in nodes.columns else ""
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
        blocks = nodes.groupBy("tree", F.shiftright("pos", BITS).alias("block"))
        rounds.append(written(blocks.applyInArrow(lambda rows: _block(rows, bits), f"{kinds}, path {_PATH}, top string{extra}"), "blocks"))
        if (rounds[-1].agg(F.max("total")).first()[0] or 0) <= 1 << BITS:
            return rounds
        nodes = rounds[-1].filter("top is not null").select(
            "tree",
            F.shiftright("pos", BITS).alias("pos"),
            F.col("top").alias("digest"),
            F.ceil(F.col("total") / (1 << BITS)).cast("long").alias("total"),
        )


def _above(rounds: list[DataFrame]) -> DataFrame:
    """(tree, pos, upper): for every block of the first round, the path from its root to the tree's."""
    root = rounds[-1].filter("top is not null").select("tree", F.shiftright("pos", BITS).alias("pos"))
    out = root.withColumn("upper", F.array().cast(_PATH))
    for own in reversed(rounds[1:]):
        higher = out.select("tree", F.col("pos").alias("_above"), "upper")
        own = own.select("tree", "pos", "path", F.shiftright("pos", BITS).alias("_above"))
        out = own.join(higher, ["tree", "_above"]).select("tree", "pos", F.concat("path", "upper").alias("upper"))
    return out


@dataclass
class Manifest:
    """Written tables of a manifest.

    ``leaves``: key, tree, pos, leaf, changed (null where the leaf is as it was), path and copies
    within the block; ``upper``: for every block (tree, pos) the path from its root to the root of
    all, with subroot; ``root`` is null for an empty table.
    """

    leaves: DataFrame
    upper: DataFrame
    root: str | None

    def rows(self) -> DataFrame:
        """A row per leaf, with its whole path (``steps``) and all nodes its version copies (``copied``)."""
        upper = self.upper.withColumnRenamed("pos", "_block")
        rows = self.leaves.withColumn("_block", F.shiftright("pos", BITS)).join(upper, ["tree", "_block"])
        begin = F.when(F.size("copies") > 0, F.element_at("copies", -1)).otherwise(F.col("changed"))
        # The version that left the block goes on, a copy for each level.
        higher = F.aggregate(
            "upper",
            F.array(begin),
            lambda done, s: F.concat(done, F.array(F.sha2(F.concat(s["left"], F.element_at(done, -1), s["right"]).cast("binary"), 256))),
        )
        copied = F.concat("copies", F.slice(higher, F.lit(2), F.size("upper")))
        return rows.drop("_block").select(
            "*", F.concat("path", "upper").alias("steps"), F.when(F.col("changed").isNotNull(), copied).alias("copied")
        )

    def copied_nodes(self) -> DataFrame:
        """(tree, pos, level, digest): the nodes of each version, that of the leaf at (tree, pos), that are not shared."""
        changed = self.rows().filter("changed is not null")
        own = F.concat(F.array("changed"), "copied")
        return changed.select("tree", "pos", F.posexplode(own).alias("level", "digest"))


def manifest(
    docs: DataFrame,
    fields: Iterable[str] = FIELDS,
    key: str = "doc_id",
    group: str = "lang",
    tampered: Column | None = None,
    changes: dict[str, Column] | None = None,
) -> Manifest:
    """The trees over all rows, and a version for each row that ``tampered`` is true for.

    A leaf hashes ``fields`` (see ``leaf_digest``); the values in ``changes`` stand in for those of a
    tampered row. Leaves of a group ascend by key, null first, and those of one key by their
    digest; while several nodes are left, every two in a row, and a last one by itself, become the hash
    of their digests in hex. Groups ascend by the bytes of their text, null first, and their roots are hashed
    likewise. A change that leaves the digest as it was makes no version.

    Only keys and digests are shuffled, so long texts and other columns play no part; rows that are equal are
    leaves each. An empty table has no leaves and a null root. A third of all rows may be one group: blocks
    are dealt by position, ranks by slices of the key.
    """
    values = {f: F.col(f"`{f}`") for f in fields}
    leaf = leaf_digest(values.values())
    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(tampered, leaf_digest([(changes or {}).get(f, c) for f, c in values.items()]))
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    keyed = docs.select(F.col(f"`{key}`").alias("key"), tree.alias("tree"), leaf.alias("digest"), changed.alias("changed"))
    keyed = keyed.withColumn("changed", F.nullif("changed", "digest"))
    keyed = written(keyed.withColumn("_place", F.struct("key", "digest")), "leaves")
    placed = rank_within(range_buckets(keyed, "_place"), ["tree"], ["_place"], F.col("_range"), "pos", "total")
    placed = placed.select("tree", (F.col("pos") - 1).alias("pos"), "digest", "total", "key", "changed")
    rounds = _climb(placed)

    roots = rounds[-1].filter("top is not null").select(F.col("tree").alias("name"), F.col("top").alias("digest"))
    ranked = rank_within(range_buckets(roots, "name"), [], ["name"], F.col("_range"), "pos", "total")
    over = _climb(ranked.select(F.lit("").alias("tree"), (F.col("pos") - 1).alias("pos"), "digest", "total", "name"))
    top = over[-1].filter("top is not null").select("top").first()
    whole = _above(over).select(F.col("pos").alias("_block"), F.col("upper").alias("_rest"))
    of_trees = over[0].withColumn("_block", F.shiftright("pos", BITS)).join(whole, "_block")
    of_trees = of_trees.select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.concat("path", "_rest").alias("_over")
    )
    upper = _above(rounds).join(of_trees, "tree")
    upper = upper.select("tree", "pos", F.concat("upper", "_over").alias("upper"), "subroot")
    leaves = rounds[0].withColumnRenamed("digest", "leaf").drop("top", "total")
    return Manifest(leaves, written(upper, "upper"), top[0] if top else None)


def verify(
    docs: DataFrame,
    fields: Iterable[str] = FIELDS,
    key: str = "doc_id",
    group: str = "lang",
    tampered: Column | None = None,
    changes: dict[str, Column] | None = None,
) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``proof_sha256`` hashes the siblings on the way from the leaf to the root, level by level.
    ``folded_root`` is the root of the row's version, made of its leaf as it is now (after tampering)
    and the original siblings; ``verified`` tells that it is the original root. See ``manifest`` for
    nulls, ties, repeated rows and empty tables.
    """
    made = manifest(docs, fields, key, group, tampered, changes)
    rows = made.rows()
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    hashed = lambda done, s: F.sha2(F.concat(s["left"], done, s["right"]).cast("binary"), 256)
    # A version of a lone leaf has copied nothing: it is the root itself.
    of_version = F.coalesce(F.element_at("copied", -1), F.col("changed"))
    folded = F.when(F.col("changed").isNull(), F.aggregate("steps", F.col("leaf"), hashed)).otherwise(of_version)
    out = rows.select(
        F.col("key").alias(key), "leaf", "subroot", F.lit(made.root).cast("string").alias("root"),
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
