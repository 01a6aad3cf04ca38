"""Merkle manifest of a dataset: a hash tree per group, one over the groups, and a proof for every row.

Trees are built from the leaves up, in blocks of ``2 ** STEP`` neighbours, so that a task holds one block at a
time however large a group is. Proofs come from pointer jumping. At first every node points to its parent and holds the
sibling it is hashed with. Joining the nodes with themselves doubles the distance of all
pointers and puts the segments of siblings together; after as many rounds as the depth has
binary digits every leaf points to the root and holds its whole proof.

A node is (tree, level, index): trees are the groups by number, the last is the one over them, ``TOP``. A group's
highest node is the leaf of that number there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_stage, stage, stage_at
from .places import with_places

TOP = -1
STEP = 10
BROADCAST_BYTES = 8 << 20
NODE = ["tree", "level", "index"]
SIBLING = "struct<before:boolean,digest:binary>"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(text: Column) -> Column:
    """SHA-256 of a text as binary."""
    return F.unhex(F.sha2(text, 256))


def leaf_of(values: list[Column]) -> Column:
    """Digest of a row's values: each its UTF-8 byte count, ``:`` and itself, ``-`` if it is null."""
    text = [v.cast("string") for v in values]
    return hashed(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def height_of(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def _parents(level: Column) -> Column:
    """Digests of each two consecutive ones, the last one's alone if it has no neighbour."""
    pair = lambda i: hashed(F.concat(hexed(F.get(level, 2 * i)), F.coalesce(hexed(F.get(level, 2 * i + 1)), F.lit(""))))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)


def _block_nodes(nodes: DataFrame, base: int) -> DataFrame:
    """All nodes of the blocks over ``nodes`` of level ``base``, with their siblings; ``digest`` is given for each block's highest one.

    ``nodes``: ``tree, height, index, digest, own``. A block ends at the tree's height.
    """
    steps = F.least(F.lit(STEP), F.col("height") - base)
    blocks = nodes.groupBy("tree", "height", F.shiftright("index", STEP).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("index", "digest", "own"))).alias("members")
    )
    first = F.array(F.transform("members", lambda m: m["digest"]))
    grown = F.aggregate(F.sequence(F.lit(1), steps), first, lambda done, k: F.concat(done, F.array(_parents(F.element_at(done, -1)))))
    node = lambda level, up, i, digest, sibling, own: F.struct(
        (up + base).cast("int").alias("level"),
        (F.call_function("shiftleft", F.col("block"), F.lit(STEP) - up) + i).alias("index"),
        digest.alias("digest"),
        sibling.alias("sibling"),
        own.alias("own"),
    )
    none = F.lit(None)
    kind = nodes.schema["own"].dataType

    def of_level(up: Column) -> Column:
        level = F.get("levels", up)
        return F.transform(
            level,
            lambda d, i: node(
                level,
                up,
                i,
                F.when(up == F.size("levels") - 1, d),
                F.when(up < F.size("levels") - 1, F.get(level, i.bitwiseXOR(F.lit(1)))),
                F.when(up == 0, F.get("members", i)["own"]).otherwise(none.cast(kind)),
            ),
        )

    levels = blocks.select("tree", "height", "block", "members", grown.alias("levels"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size("levels") - 1), of_level))
    return levels.select("tree", "height", F.inline(every))


def _tree_nodes(leaves: DataFrame, height: int) -> tuple[DataFrame, DataFrame]:
    """Nodes below the highest ones (``tree, height, level, index, sibling, own``), and ``(tree, digest)`` of the highest, of
    all trees whose leaves are given as ``tree, height, index, digest, own``; none of them is higher than ``height``."""
    roots = [leaves.where("height = 0").select("tree", "digest")]
    below, now = [], leaves.where("height > 0")
    for base in range(0, height, STEP):
        made = stage(_block_nodes(now, base), "merkle-nodes")
        highest = made.where("digest IS NOT NULL")
        below.append(made.where("digest IS NULL").select("tree", "height", "level", "index", "sibling", "own"))
        roots.append(highest.where("level = height").select("tree", "digest"))
        now = highest.where("level < height").select("tree", "height", "index", "digest", F.lit(None).cast(leaves.schema["own"].dataType).alias("own"))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    none = leaves.where("false").select("tree", "height", F.lit(0).alias("level"), "index", F.col("digest").alias("sibling"), "own")
    return union(below or [none]), union(roots)


def _pointed(nodes: DataFrame) -> DataFrame:
    """Nodes with a pointer to their parent and a segment of one sibling, null where there is none."""
    before = F.col("index").bitwiseAND(F.lit(1)) == 1
    return nodes.select(
        *NODE,
        F.col("tree").alias("up_tree"),
        (F.col("level") + 1).alias("up_level"),
        F.shiftright("index", 1).alias("up_index"),
        F.array(F.struct(before.alias("before"), F.col("sibling").alias("digest"))).cast(f"array<{SIBLING}>").alias("segment"),
        "own",
    )


def _jumped(rows: DataFrame, nodes: DataFrame, small: bool) -> DataFrame:
    """``rows`` that point as far again: to where the nodes they point to do, with both segments."""
    far = nodes.select(
        *[F.col(c).alias(f"by_{c}") for c in NODE], *[F.col(f"up_{c}").alias(f"to_{c}") for c in NODE], F.col("segment").alias("rest")
    )
    met = reduce(Column.__and__, [F.col(f"up_{c}") == F.col(f"by_{c}") for c in NODE])
    joined = rows.join(F.broadcast(far) if small else far, met)
    return joined.select(
        *NODE, *[F.col(f"to_{c}").alias(f"up_{c}") for c in NODE], F.concat("segment", "rest").alias("segment"), "own"
    )


def merkle_proofs(rows: DataFrame, group: str, order: list[str], digest: str) -> DataFrame:
    """``rows`` with ``place`` (in its group, from 0), ``subroot``, ``root`` and ``proof``; these replace columns of these names.

    Leaves are the binary column ``digest``, by group in ascending ``order``, nulls first, ties by digest. Every two
    consecutive nodes become the hash of their digests' hex digits one after the other, a last
    one alone that of its own, until one is left: the group's ``subroot`` (hex digits; a single leaf itself). The
    subroots, by ascending group, null first, give ``root`` in the same way. ``proof`` lists, from the
    leaf up, one entry per level: the sibling's ``digest``, null where there is none, and whether it
    comes ``before`` the own one.

    Rows repeated as a whole are leaves of their own; a table of one row is its own root with an empty
    proof; an empty table gives no rows. All columns of ``rows`` are kept, whatever their names.

    Neighbours are hashed in blocks of 1,024, and only nodes that a later round can meet are
    kept, so a round moves little more than the leaves. Nodes are broadcast only while they have at
    most 8 MB, by a bound from the number of rows; before, both sides are shuffled by node. Each round is written to the shared
    checkpoint folder. The driver sees the distinct heights of the trees, no digest but the root.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c.lower() not in ("place", "subroot", "root", "proof")]
    own = F.struct(*[F.col(f"`{c}`") for c in kept])
    leaves = rows.select(F.col(f"`{group}`").alias("lead"), F.col(f"`{digest}`").alias("digest"), own.alias("own"))
    by = [F.col(f"own.`{c}`").asc_nulls_first() for c in order] + [F.col("digest").asc()]
    leaves, sizes = with_places(leaves, ["lead"], by, "index")
    trees, _ = with_places(sizes.select("lead", height_of(F.col("n")).alias("height")), [], [F.col("lead").asc_nulls_first()], "tree")
    trees = stage(trees.select(F.col("lead").alias("of"), "height", F.col("tree").cast("int").alias("tree")), "trees")
    depths = sorted((h, n) for h, n in trees.groupBy("height").count().collect())  # at most one row per height
    if not depths:
        ends = (("place", "long"), ("subroot", "string"), ("root", "string"), ("proof", f"array<{SIBLING}>"))
        return rows.where("false").select(*[f"`{c}`" for c in kept], *[F.lit(None).cast(t).alias(c) for c, t in ends])
    n_trees, highest = sum(n for _, n in depths), depths[-1][0]
    top = 0 if n_trees == 1 else (n_trees - 1).bit_length()

    placed = leaves.join(trees, F.col("lead").eqNullSafe(F.col("of"))).select("tree", "height", "index", "digest", "own")
    placed = stage(placed, "leaves")
    below, subroots = _tree_nodes(placed, highest)
    subroots = stage(subroots, "subroots")
    over = subroots.select(F.lit(TOP).alias("tree"), F.lit(top).alias("height"), F.col("tree").cast("long").alias("index"), "digest", F.lit(None).cast("int").alias("own"))
    above, roots = _tree_nodes(over, top)
    root = roots.first()["digest"] if top else subroots.first()["digest"]
    end = (TOP, top, 0) if top else (0, highest, 0)

    # The groups' highest nodes point on into the tree over them, and so do leaves that are such nodes.
    mine = [f"level = 0 AND tree != {TOP}", f"NOT (level = 0 AND tree != {TOP})"]
    pointed = _pointed(below)
    upper = _pointed(above)
    joints = (
        upper.where("level = 0")
        .withColumnRenamed("index", "joint")
        .join(trees.select(F.col("tree").alias("number"), "height"), F.col("joint") == F.col("number"))
        .select(F.col("number").alias("tree"), F.col("height").alias("level"), F.lit(0).cast("long").alias("index"), "up_tree", "up_level", "up_index", "segment")
    )
    alone = placed.where("height = 0").select("tree", F.lit(0).alias("level"), "index", "own")
    if top:
        alone = alone.join(joints.where("level = 0").drop("level", "index"), "tree").select(*pointed.columns)
    else:
        up = [F.lit(x).cast(t).alias(f"up_{c}") for c, x, t in zip(NODE, end, ("int", "int", "long"))]
        alone = alone.select(*NODE, *up, F.array().cast(f"array<{SIBLING}>").alias("segment"), "own")
    lone = pointed.where(mine[0]).unionByName(alone)
    nothing = F.lit(None).cast("int")
    nodes = pointed.where(mine[1]).drop("own").unionByName(joints).unionByName(upper.where("level > 0").drop("own")).withColumn("own", nothing)

    done = reduce(Column.__and__, [F.col(f"up_{c}") == x for c, x in zip(NODE, end)])
    most = int(sizes.agg(F.sum("n")).first()[0])
    finished, dropped = [], []
    distance = 1
    while True:
        if distance >= highest + top:
            finished.append(lone.where(done))
            break
        if any(h + top <= distance for h, _ in depths):
            finished.append(lone.where(done))
        bytes_ = (2 * (most >> distance) + n_trees * (highest // distance + 4)) * (120 + 48 * distance)
        small = bytes_ <= BROADCAST_BYTES
        met = (F.col("tree") == TOP) | (F.col("level") % distance == 0)
        nodes = nodes.where(met)
        lone, path = stage_at(_jumped(lone.where(~done), nodes, small), "proofs")
        later = (F.col("tree") == TOP) | (F.col("level") % (2 * distance) == 0)
        moved = _jumped(nodes.where(later & ~done), nodes, small).unionByName(nodes.where(later & done))
        nodes, nodes_path = stage_at(moved, "pointers")
        distance *= 2
        for old in dropped:
            drop_stage(spark, old)
        # Leaves that reach the root in this round are read from here in the end.
        dropped = [nodes_path] + ([path] if not any(distance // 2 < h + top <= distance for h, _ in depths) else [])
    whole = reduce(DataFrame.unionByName, finished)
    marks = subroots.select(F.col("tree").alias("of"), hexed(F.col("digest")).alias("subroot"))
    return whole.join(marks, F.col("tree") == F.col("of")).select(
        *[F.col(f"own.`{c}`").alias(c) for c in kept],
        F.col("index").alias("place"),
        "subroot",
        hexed(F.lit(bytes(root))).alias("root"),
        F.col("segment").alias("proof"),
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root, as hex digits, that a leaf's binary digest and a proof lead to."""

    def up(own: Column, s: Column) -> Column:
        sibling = F.coalesce(hexed(s["digest"]), F.lit(""))
        return F.sha2(F.when(s["before"], F.concat(sibling, own)).otherwise(F.concat(own, sibling)), 256)

    return F.aggregate(proof, hexed(leaf), up)


def tampered(doc_id: Column) -> Column:
    """Rows that the query's tampering changes: 7 divides the checksum of the id as text. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: leaf, roots, proof and whether the root still follows when ``n_chars`` of some rows is one more.

    Reads ``doc_id, source, lang, n_chars, text``, any of which may be null.
    """
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [*values[:3], values[3] + 1, values[4]]
    seen = F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), leaf_of(changed))
    leaves = docs.select("doc_id", "lang", leaf_of(values).alias("leaf"), seen.alias("seen"))
    proofs = merkle_proofs(leaves, "lang", ["doc_id"], "leaf")
    siblings = F.transform(F.filter("proof", lambda s: s["digest"].isNotNull()), lambda s: hexed(s["digest"]))
    return proofs.select(
        "doc_id",
        hexed(F.col("leaf")).alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        folded(F.coalesce("seen", "leaf"), F.col("proof")).alias("folded_root"),
        "lang",
        "place",
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
