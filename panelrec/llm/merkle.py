"""A Merkle manifest of a table: one tree a source, a tree of their roots on top, proofs by a recursive query.

Leaves are numbered by one range sort and counts of its parts. A tree is built ``stride`` levels at a time: 3^stride
consecutive nodes meet in one group, whatever the size of their source, and every node of the group's lowest level is
stored as a row that names its ancestor ``stride`` levels up and the siblings passed on the way (``nodes``). The
recursive query of ``climb`` starts at every leaf and follows these links to the root, appending siblings and folding.

Nulls: a null column enters a leaf as ``-``; rows without source form the first tree, rows without id are the first
leaves of theirs and are never tampered with. Rows of one id are ordered by leaf; equal rows are equal leaves side by
side. Empty texts are values of length 0. An empty table has no leaves and gives no rows. Columns other than the five
leaf columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelrec.llm.common import discard, staged

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
STRIDE = 6
TOP = -1  # the tree over the sources' roots


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """Digest of a documents row whose text is ``text``, as binary."""
    fields = [_field(F.col(c)) for c in COLUMNS[:-1]] + [_field(text)]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, leaf, bent)``: digest of each row and of the row as tampered with.

    Where the id's checksum is even, tampering deletes the text's line feeds; elsewhere nothing.
    """
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    bent = F.when(even, F.translate(F.col("text"), "\n", "")).otherwise(F.col("text"))
    return docs.select("doc_id", "source", leaf_of(F.col("text")).alias("leaf"), leaf_of(bent).alias("bent"))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``pos``, the place from 0 within ``group`` by ``order``, and ``n``, the group's rows; staged.

    One range shuffle; rows equal in all keys are split by where they lie in the input, so neither a large group nor
    a large set of equal rows meets in one task. Windows see one row for each part of a group.
    """
    keys = [F.col(c) for c in (*group, *order)] + [F.col("__tie")]
    sorted_rows = staged(
        rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    counts = sorted_rows.groupBy(part, *group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*group)
    before = F.sum("__c").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        F.col("__part").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], "__first",
        F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__c").over(whole).alias("n"))
    same = F.shiftright("__at", 33) == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    out = staged(sorted_rows.join(offsets, same).select(
        *rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"), "n"))
    discard(sorted_rows)
    return out


_HEX = "lower(hex({}))"
#: Fold one step into the hex text of a digest.
_FOLD = f"aggregate(steps, {{}}, (a, s) -> sha2(cast(concat({_HEX.format('s.l')}, a, {_HEX.format('s.r')}) as binary), 256))"
_PROOF = "aggregate(steps, cast('' as binary), (a, s) -> concat(a, s.l, s.r))"
_BYTES = "aggregate({}, cast('' as binary), (a, x) -> concat(a, x))"


def _block(rows: DataFrame, level: int, stride: int) -> DataFrame:
    """Rows ``(tree, pos, n, digest, up_*, ...)`` of one level, with their steps through the next ``stride`` levels.

    ``top`` is the digest of the highest node of the row's group: the ancestor named by the link, or the tree's root.
    """
    own = [c for c in rows.columns if c not in ("tree", "n")]
    width = FAN ** stride
    grouped = rows.groupBy("tree", "n", F.expr(f"pos div {width}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", *[c for c in own if c != "pos"]))).alias("members"))
    grouped = grouped.withColumn("l0", F.expr("transform(members, x -> x.digest)"))
    for i in range(1, stride + 1):  # a level is there while the one below it has more than one node in the whole tree
        runs = (f"transform(sequence(0, (size(l{i - 1}) - 1) div {FAN}), i -> unhex(sha2(cast({_HEX.format(_BYTES.format(f'slice(l{i - 1}, i * {FAN} + 1, {FAN})'))} as binary), 256)))")
        grouped = grouped.withColumn(f"l{i}", F.expr(f"if(n > {FAN ** (i - 1)}, {runs}, null)"))
    steps = []
    for i in range(stride):
        at, first = f"(j div {FAN ** i})", f"(j div {FAN ** (i + 1)} * {FAN})"
        left = _BYTES.format(f"slice(l{i}, {first} + 1, {at} - {first})")
        right = _BYTES.format(f"slice(l{i}, {at} + 2, {first} + {FAN - 1} - {at})")
        steps.append(f"if(l{i + 1} is null, null, named_struct('l', {left}, 'r', {right}))")
    placed = grouped.select(
        "tree", "n", "block", F.expr(f"element_at(coalesce({', '.join(f'l{i}' for i in range(stride, -1, -1))}), 1)").alias("top"),
        F.explode(F.expr(f"transform(members, (x, j) -> struct(x as row, array_compact(array({', '.join(steps)})) as steps))")).alias("m"))
    inside = F.col("n") > width
    return placed.select(
        "tree", F.lit(level).alias("level"), *[F.col(f"m.row.{c}").alias(c) for c in own], "n", "m.steps", "top", "block",
        F.when(inside, F.col("tree")).when(F.col("tree") != TOP, F.lit(TOP)).alias("up_tree"),
        F.when(inside, F.lit(level + stride)).when(F.col("tree") != TOP, F.lit(0)).alias("up_level"),
        F.when(inside, F.col("block")).when(F.col("tree") != TOP, F.col("tree")).alias("up_pos"))


def _grown(rows: DataFrame, stride: int) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of all stored levels above and with ``rows``, and the roots ``(tree, digest)``."""
    stored, roots, level = [], [], 0
    width = FAN ** stride
    while True:
        now = staged(_block(rows, level, stride))
        stored.append(now)
        heads = now.where(f"pos % {width} = 0").select("tree", F.col("block").alias("pos"), "n", F.col("top").alias("digest"))
        roots.append(heads.where(f"n <= {width}").select("tree", "digest"))
        if not now.agg(F.max("n").alias("n")).where(f"n > {width}").count():
            break
        rows = heads.where(f"n > {width}").withColumn("n", F.expr(f"(n + {width - 1}) div {width}"))
        level += stride
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return stored, out


def manifest(docs: DataFrame, stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """The stored tree of ``docs``: ``(leaf rows, node rows)``, both with steps and link; staged.

    Leaf rows carry ``doc_id``, ``digest`` (the leaf) and ``bent``; node rows ``tree``, ``level``, ``pos``, ``digest``.
    """
    placed = numbered(leaves(docs), ["source"], ["doc_id", "leaf"])
    sources = numbered(placed.groupBy("source").agg(F.max("n").alias("rows")), [], ["source"])
    trees = sources.select(F.col("source").alias("__s"), F.col("pos").alias("tree"))
    rows = placed.join(trees, F.col("source").eqNullSafe(F.col("__s"))).select("tree", "pos", "n", F.col("leaf").alias("digest"), "doc_id", "bent")
    stored, roots = _grown(rows, stride)
    top = roots.join(sources.select(F.col("pos").alias("tree"), F.col("n").alias("count")), "tree").select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("count").alias("n"), "digest")
    above, _ = _grown(top, stride)
    names = ["tree", "level", "pos", "digest", "steps", "top", "up_tree", "up_level", "up_pos"]
    nodes = above[0].select(*names)
    for part in [*stored[1:], *above[1:]]:
        nodes = nodes.unionByName(part.select(*names))
    nodes = staged(nodes)
    discard(placed, sources, *stored[1:], *above)
    return stored[0], nodes


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """Recursive queries over any number of rows while the block runs; the caller's setting comes back after it."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def climb(leaf_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a leaf: digests of its tree's root and of the whole, its siblings and the root folded from ``bent``; staged.

    A step's rows are as many as the leaves, and steps as many as stored levels. Spark picks the join with the node
    rows, a 3^stride part of the leaves, by their size; near the root many leaves meet one node, which adaptive
    execution splits.
    """
    spark = leaf_rows.sparkSession
    query = f"""
        with recursive ascent as (
            select doc_id, digest as leaf, {_FOLD.format(_HEX.format('bent'))} as folded, {_PROOF} as proof,
                cast(null as binary) as subroot, cast(null as binary) as root, up_tree, up_level, up_pos
            from {{leaves}}
            union all
            select a.doc_id, a.leaf, {_FOLD.format('a.folded')}, concat(a.proof, {_PROOF}),
                if(n.tree = {TOP} and n.level = 0, n.digest, a.subroot), if(n.up_tree is null, n.top, a.root),
                n.up_tree, n.up_level, n.up_pos
            from ascent a join {{nodes}} n on a.up_tree = n.tree and a.up_level = n.level and a.up_pos = n.pos
        )
        select doc_id, {_HEX.format('leaf')} as leaf, {_HEX.format('subroot')} as subroot, {_HEX.format('root')} as root,
            sha2(cast({_HEX.format('proof')} as binary), 256) as proof_sha256, folded as folded_root
        from ascent where up_tree is null"""
    with _unlimited(spark):
        return staged(spark.sql(query, leaves=leaf_rows, nodes=nodes).withColumn("verified", F.expr("folded_root = root")))


def verified(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Manifest of ``docs`` and the proof of every row, tampered rows folded as they read now."""
    leaf_rows, nodes = manifest(docs.select(*COLUMNS), stride)
    out = climb(leaf_rows, nodes)
    discard(leaf_rows, nodes)
    return out
