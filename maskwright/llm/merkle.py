"""Merkle manifest of a table: time-forward processing over an external priority queue of node labels.

A node's label is (level, tree, place). Each node sends its digest to its parent's label, and the queue
is a written table of these messages: a round takes all messages of the least level off the queue in
label order, hashes the at most sixteen that share a label and writes the digests to the next parents
onto the queue. When only roots are left the sweep turns round: labels are taken in falling order and
every node hands its children the proof steps above them, so a proof is never looked up. A message
goes to one of N/16 labels, whatever the source, so no source and no level meets in one task; only the
number of levels comes to the driver.

Defined cases: an empty table gives no rows; a null column is hashed as ``-``; a
null doc_id comes before all others of its source, equal doc_ids follow their leaf's digest, and rows
that are equal throughout get the places of their run in any order (their output differs in the proofs
of those places only); extra columns are not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import materialise

#: Children of a node.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<l:string,r:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(**instead: Column) -> Column:
    """Digest of a row: each field as ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    values = [instead.get(f, F.col(f)).cast("string") for f in FIELDS]
    return digest(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values))


def ranged(rows: DataFrame, tree: str, *order: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows cut into ranges by tree and order, each sorted, and the heads of the trees in the ranges.

    Rows get ``_range`` and ``_at``, heads (tree, _range, _first, _before, n) tell the first ``_at`` of a
    tree in a range, its rows in the ranges before and its rows altogether. Rows equal in ``order`` are
    dealt to several ranges.
    """
    at, tie = F.monotonically_increasing_id(), "_tie"
    cut = rows.withColumn(tie, at).repartitionByRange(tree, *order, tie).sortWithinPartitions(tree, *order, tie).drop(tie)
    cut = materialise(cut.withColumn("_at", at), name).withColumn("_range", F.shiftright("_at", 33))
    heads = cut.groupBy(tree, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    of = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_c").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut, heads.select(tree, "_range", "_first", before.alias("_before"), F.sum("_c").over(of).alias("n"))


#: A row's place in its tree.
_POS = "_at - _first + _before"


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From (tree, pos, n, digest, payload) to the levels above (tree, pos, n, digest, kids) and the roots (tree, digest, height).

    ``n`` is the number of nodes of the tree on the node's level. A tree leaves the queue once its
    root is computed.
    """
    most, levels, roots = nodes.agg(F.max("n")).first()[0] or 0, [], nodes.filter("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    queue = nodes.filter("n > 1")
    while most > 1:
        to = queue.withColumn("to", F.floor(F.col("pos") / FAN).cast("long"))
        to = to.repartitionByRange("tree", "to").sortWithinPartitions("tree", "to", "pos")  # the queue in label order
        kids = F.array_sort(F.collect_list(F.struct("pos", "digest", "payload")))
        taken = to.groupBy("tree", F.col("to").alias("pos")).agg(F.floor((F.max("n") + FAN - 1) / FAN).cast("long").alias("n"), kids.alias("kids"))
        level = taken.withColumn("digest", digest(F.array_join(F.transform("kids", lambda k: k["digest"]), "")))
        levels.append(level := materialise(level, f"level-{len(levels) + 1}"))
        roots = roots.unionAll(level.filter("n = 1").select("tree", "digest", F.lit(len(levels)).alias("height")))
        queue = level.filter("n > 1").select("tree", "pos", "n", "digest", F.lit(None).cast(nodes.schema["payload"].dataType).alias("payload"))
        most = -(-most // FAN)
    return levels, roots


def descend(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, pos, digest, payload, of, path) of every node of level 0, in the reversed order of labels.

    ``above`` has (tree, height, of, path): the steps above each tree's root, and what goes down with
    them. A step holds the digests to
    the left and to the right of the node in its run; steps go from the node's own level upwards.
    """
    starts = above.withColumn("pos", F.lit(0).cast("long"))
    paths = None  # of the nodes of the level at hand
    for height in range(len(levels), 0, -1):
        here = starts.filter(F.col("height") == height).select("tree", "pos", "of", "path")
        here = here if paths is None else here.unionAll(paths.select("tree", "pos", "of", "path"))
        rows = levels[height - 1].select("tree", "pos", "kids").join(here, ["tree", "pos"])
        kid = rows.select("tree", "kids", "of", "path", F.posexplode("kids").alias("i", "kid"))
        side = lambda cond: F.array_join(F.transform(F.filter("kids", cond), lambda k: k["digest"]), "")
        step = F.struct(side(lambda k: k["pos"] < F.col("kid.pos")).alias("l"), side(lambda k: k["pos"] > F.col("kid.pos")).alias("r"))
        paths = kid.select("tree", F.col("kid.pos").alias("pos"), F.col("kid.digest").alias("digest"), F.col("kid.payload").alias("payload"), "of", F.concat(F.array(step), "path").alias("path"))
    alone = nodes.filter("n = 1").join(starts.filter("height = 0").select("tree", "of", "path"), "tree").select("tree", "pos", "digest", "payload", "of", "path")
    return alone if paths is None else paths.unionAll(alone)


def manifest(docs: DataFrame, tampered: Column, text_after: Column) -> DataFrame:
    """Digests, proof and its verdict for every document.

    Columns: doc_id, leaf, subroot (of its source), root, proof_sha256 (digest of the siblings from
    the leaf's run to the root's), folded_root (recomputed from the leaf as it is now and the
    siblings as they were) and verified. Rows where ``tampered`` holds have ``text_after`` now.
    """
    now = F.when(tampered, leaf(text=text_after))
    leaves = docs.select("source", "doc_id", leaf().alias("digest"), now.alias("now"))
    leaves, heads = ranged(leaves, "source", "doc_id", "digest", name="leaves")
    heads = materialise(heads, "heads")
    # sources get their places by code point, null first; a place stands for the source from here on
    sources, of_all = ranged(heads.select("source").distinct().withColumn("all", F.lit(0)), "all", "source", name="sources")
    sources = sources.join(of_all.select("_range", "_first", "_before"), "_range").select(F.col("source").alias("_s"), F.expr(_POS).alias("tree"))
    heads = heads.join(sources, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    heads = heads.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_first", "_before", "n", "tree")
    nodes = leaves.join(heads, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    nodes = materialise(nodes.select("tree", F.expr(_POS).alias("pos"), "n", "digest", F.struct("doc_id", "now").alias("payload")), "nodes")
    levels, roots = climb(nodes)
    roots = materialise(roots, "subroots")
    top = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(roots.count()).cast("long").alias("n"), "digest", F.struct("height").alias("payload"))
    top = materialise(top, "top")
    upper, root = climb(top)
    whole = root.first()  # one row, none for an empty table; its own path is empty
    start = root.select("tree", "height", F.col("digest").alias("of"), F.expr(f"cast(array() as array<{_STEP}>)").alias("path"))
    known = descend(top, upper, start).select(F.col("pos").alias("tree"), F.col("payload.height").alias("height"), F.col("digest").alias("of"), "path")
    proved = descend(nodes, levels, materialise(known, "paths"))
    fold = F.aggregate("path", F.coalesce("payload.now", "digest"), lambda a, p: digest(p["l"], a, p["r"]))
    proof = digest(F.array_join(F.transform("path", lambda p: F.concat(p["l"], p["r"])), ""))
    out = proved.select(F.col("payload.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("of").alias("subroot"), F.lit(whole["digest"] if whole else None).cast("string").alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
