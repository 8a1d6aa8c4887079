"""Merkle manifest of a dataset: nodes labelled with the interval of leaf ranks that they cover.

Every row is a leaf. The leaves of one source, in order of their doc_id, are numbered from 0; a node of level k covers
the half-open interval of ranks [j * 16^k, (j + 1) * 16^k), cut at the end. A parent is found by a containment join inside the
bucket of its level (rank div 16^(k + 1)), and a node's siblings are what is left of the parent's interval when the node's own
is taken away: what ends before it, and what begins after it. The sources' roots are the leaves of one more such tree.

Leaves never meet a tree's upper levels one by one: levels are built bottom-up from runs of 16, paths go down from the root,
each node handing its own on to its children, and the leaves of a run share the path of their run. All of it is
grouping, joins on (tree, bucket) and expressions; a level's table is a sixteenth of the one below.

Numbering: rows are sorted by range of (source, doc_id, leaf, row number), so that neither a source with a third of all rows nor
repeated rows fill one task, numbered where they lie, and shifted by the counts of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, partitions, released, saved

WIDTH = 16
_PLACE = (1 << 33) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "tree", "lo", "hi", "n", "digest", "members"


def field(value: Column) -> Column:
    """A value as hashed: ``-`` if null, else its UTF-8 bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values' fields laid end to end."""
    return F.sha2(F.concat(*map(field, values)), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where 5 divides the unsigned CRC-32 of the decimal doc_id, else as it is (a null doc_id has none)."""
    return F.when(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def ranked(rows: DataFrame, tree: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``rank`` from 0 within each combination of ``tree`` columns, in ``order``; the trees with their number ``n`` of rows).

    Ties are broken by a row number that is read back from a written table. Nulls come first and are a tree of their own.
    """
    spark = rows.sparkSession
    rows = saved(rows.withColumn("_row", F.monotonically_increasing_id()), f"{name}_rows")
    keys = [*tree, *order, "_row"]
    lying = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    lying = saved(lying.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_PLACE))).drop("_row"), f"{name}_sorted")
    parts = saved(lying.groupBy("_part", *tree).agg(F.count("*").alias("_m"), F.min("_at").alias("_first")), f"{name}_parts")
    before = Window.partitionBy(*tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("_base", F.coalesce(F.sum("_m").over(before), F.lit(0)) - F.col("_first"))
    bases = saved(bases.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_t_{c}") for c in tree], "_base"), f"{name}_bases")
    same = F.col("_part") == F.col("_p")
    for c in tree:
        same &= F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    out = lying.join(checked(bases), same).withColumn("rank", F.col("_at") + F.col("_base"))
    return out.drop("_at", "_part", "_p", "_base", *[f"_t_{c}" for c in tree]), parts.groupBy(*tree).agg(F.sum("_m").alias("n"))


def _joined(members: Column) -> Column:
    return F.concat_ws("", F.transform(members, lambda x: x["digest"]))


def runs_of(leaves: DataFrame, name: str, *more: str) -> DataFrame:
    """Level 1: a row for each run of 16 leaves (tree, rank, n, digest), with its ``members`` in order. The one leaf of a tree is its own run, unhashed."""
    member = F.struct(F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *more)
    runs = leaves.groupBy("tree", F.expr(f"rank div {WIDTH}").alias("bucket")).agg(F.sort_array(F.collect_list(member)).alias("members"), F.first("n").alias("n"))
    digest = F.when(F.col("n") == 1, F.col("members")[0]["digest"]).otherwise(F.sha2(_joined(F.col("members")), 256))
    first, last = F.col("members")[0]["lo"], F.element_at("members", -1)["hi"]
    return saved(runs.select("tree", first.alias("lo"), last.alias("hi"), "n", digest.alias("digest"), "members"), f"{name}_runs")


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of ``level`` above those of the level below, for trees that have more than one node there."""
    below = nodes.where(F.col("n") > WIDTH ** (level - 1))
    member = F.struct("lo", "hi", "digest")
    up = below.groupBy("tree", F.expr(f"lo div {WIDTH**level}L").alias("bucket")).agg(F.sort_array(F.collect_list(member)).alias("members"), F.first("n").alias("n"))
    return up.select("tree", F.col("members")[0]["lo"].alias("lo"), F.element_at("members", -1)["hi"].alias("hi"), "n", F.sha2(_joined(F.col("members")), 256).alias("digest"), "members")


def siblings(members: Column, lo: Column, hi: Column) -> Column:
    """(left, right): the digests of the members outside the interval [lo, hi), laid end to end on either side of it."""
    left, right = F.filter(members, lambda x: x["hi"] <= lo), F.filter(members, lambda x: x["lo"] >= hi)
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))


def with_paths(runs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(level-1 runs with their ``path`` to the root, bottom-up, as (left, right) siblings; (tree, root, n)).

    Levels are added until every tree has one node; then each level's nodes find their parent by the containment join.
    """
    levels, tops = [runs], [runs.where(F.col("n") <= WIDTH)]
    while True:
        above = saved(_parents(levels[-1], len(levels) + 1), f"{name}_level")
        if not above.count():
            break
        levels.append(above)
        tops.append(above.where(F.col("n") <= WIDTH ** len(levels)))
    roots = tops[0].select("tree", F.col("digest").alias("root"), "n")
    for top in tops[1:]:
        roots = roots.unionByName(top.select("tree", F.col("digest").alias("root"), "n"))
    none = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    known = None
    for k in range(len(levels), 0, -1):
        nodes = levels[k - 1].select(*_RUN)
        if known is None:
            known = nodes.select(*_RUN, none)
            continue
        bucket = F.expr(f"lo div {WIDTH ** (k + 1)}L")
        parent = known.select(F.col("tree").alias("p_tree"), bucket.alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("members").alias("p_members"), F.col("path").alias("p_path"))
        holds = (F.col("tree") == F.col("p_tree")) & (bucket == F.col("p_bucket")) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
        path = F.concat(F.array(siblings(F.col("p_members"), F.col("lo"), F.col("hi"))), F.col("p_path"))
        known = nodes.join(checked(parent, 2000), holds, "left").select(*_RUN, F.coalesce(path, none).alias("path"))
        known = saved(known, f"{name}_paths")
    return known, roots


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and the (left, right) siblings on its path give."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def merkle_manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text") -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``proof_sha256`` is the digest of all siblings from leaf to root; ``folded_root`` is recomputed from the tampered leaf (see
    ``tampered_text``) and the original siblings, ``verified`` says whether it is the root.

    Nulls in any column are hashed as ``-``; null doc_ids come first in their source, a null source is a source of its own and comes
    first. Rows of one source and doc_id are ordered by their digest, and rows equal in all five columns are interchangeable: each
    is a leaf. Texts are hashed whole. An empty table gives no rows; other columns are ignored. Only the number of rows of
    each level comes to the driver.
    """
    spark = docs.sparkSession
    own = [F.col(f"`{c}`") for c in (doc_id, source, lang, n_chars, text)]
    changed = leaf_digest(*own[:4], tampered_text(own[0], own[4]))
    with released(spark):
        leaf = leaf_digest(*own)
        rows = docs.select(own[0].alias("doc_id"), own[1].cast("string").alias("source"), leaf.alias("digest"), F.when(tampered_text(own[0], own[4]) != own[4], changed).alias("changed"))
        leaves, sources = ranked(rows, ["source"], ["doc_id", "digest"], "merkle")
        sources, _ = ranked(sources.withColumn("all", F.lit(0)), ["all"], ["source"], "merkle_sources")
        sources = saved(sources.select(F.col("source").alias("name"), F.col("rank").alias("tree"), "n"), "merkle_trees")
        leaves = leaves.join(checked(sources), F.col("source").eqNullSafe(F.col("name")))
        runs = runs_of(leaves.select("tree", "rank", "n", "digest", "changed", "doc_id", "source"), "merkle", "changed", "doc_id", "source")
        paths, subroots = with_paths(runs, "merkle")
        top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(sources.count()).cast("long").alias("n"), F.col("root").alias("digest"))
        over, roots = with_paths(runs_of(top, "merkle_top"), "merkle_top")
        over = over.join(roots.select("tree", "root"), "tree")
        spread = over.select("root", "n", "members", "path", F.explode("members").alias("m"))
        upper = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(siblings(F.col("members"), F.col("m.lo"), F.col("m.hi"))), F.col("path")))
        upper = saved(spread.select(F.col("m.lo").alias("top_tree"), F.col("m.digest").alias("subroot"), "root", upper.alias("top_path")), "merkle_upper")
        whole = paths.join(checked(upper, 2000), F.col("tree") == F.col("top_tree"))
        whole = whole.withColumn("up", F.concat("path", "top_path")).withColumn("m", F.explode("members"))
        path = F.when(F.col("n") == 1, F.col("up")).otherwise(F.concat(F.array(siblings(F.col("members"), F.col("m.lo"), F.col("m.hi"))), F.col("up")))
        whole = whole.select("m", "subroot", "root", path.alias("path"))
        proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"]))), 256)
        back = folded(F.coalesce(F.col("m.changed"), F.col("m.digest")), F.col("path"))
        out = whole.select(F.col("m.doc_id").alias("doc_id"), F.col("m.source").alias("source"), F.col("m.digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), back.alias("folded_root"))
        return saved(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle", keep=True)
