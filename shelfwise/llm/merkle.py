"""Merkle dataset manifest by sibling-shift self-joins.

Every row is a leaf. A level holds its nodes with their place in the run of their group; it is joined with itself on the
computed places of siblings (place XOR 1 in a binary tree, slot offsets otherwise), and rows of slot zero then emit the
parents. Roots of groups make one more tree of the same kind. Proofs come back from the root down: the proof of a node is
its siblings followed by its parent's proof, so each level is one join with the level above, half as large.

H is the lowercase hex sha256 of its inputs, concatenated; digests go in as hex text. They are kept as 32 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.ranks import running
from shelfwise.llm.session import drop_scratch, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes a task: small levels are written by few tasks.
NODES_A_TASK = 20_000
#: Levels that proofs pass before they are written.
LEVELS_A_STEP = 4


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def in_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def group_key(group: Column) -> Column:
    """Sorts as the group does bytewise, null first, and is never null."""
    return F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))


def fold(digest: Column, proof: Column) -> Column:
    """The root (hex) that a leaf digest (hex) and its proof, as ``manifest`` gives it, lead to."""
    return F.aggregate(proof, digest, lambda acc, step: F.sha2(F.concat(in_hex(step["before"]), acc, in_hex(step["after"])), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof as hex text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: in_hex(F.concat(step["before"], step["after"]))), "")


def settle(df: DataFrame, nodes: int, name: str) -> DataFrame:
    return materialize(df.coalesce(-(-nodes // NODES_A_TASK) or 1), name)


def climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """(grp, place, n, digest, ...) -> a written table per level: before and after are the digests of the siblings to the
    left and right. ``n`` is the number of nodes of the group at the level; a group is done where that is 1."""
    levels, nothing = [], F.lit(b"")
    most, count = nodes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    while True:
        slot, level = F.col("place") % arity, nodes
        for shift in range(1, arity):
            sibling = F.col("place").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("place") - slot + (slot + shift) % arity
            other = nodes.select(F.col("grp").alias("g"), F.col("place").alias("p"), F.col("digest").alias(f"digest{shift}"))
            level = level.withColumn("sibling", sibling).join(other, (F.col("grp") == F.col("g")) & (F.col("sibling") == F.col("p")), "left").drop("g", "p", "sibling")
        left = F.concat(*(F.when(slot + s >= arity, F.coalesce(f"digest{s}", nothing)).otherwise(nothing) for s in range(1, arity)))
        right = F.concat(*(F.when(slot + s < arity, F.coalesce(f"digest{s}", nothing)).otherwise(nothing) for s in range(1, arity)))
        level = level.withColumns({"before": left, "after": right}).drop(*(f"digest{s}" for s in range(1, arity)))
        levels.append(settle(level, count // arity ** len(levels), f"merkle-{len(levels)}"))
        if most <= 1:
            return levels
        most = -(-most // arity)
        nodes = levels[-1].filter((F.col("n") > 1) & (F.col("place") % arity == 0)).select("grp", (F.col("place") / arity).cast("long").alias("place"), F.ceil(F.col("n") / arity).cast("long").alias("n"), F.unhex(F.sha2(in_hex(F.concat("digest", "after")), 256)).alias("digest"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """The last node of every group."""
    out = None
    for level in levels:
        done = level.filter("n = 1").select("grp", "digest")
        out = done if out is None else out.unionByName(done)
    return out


def descend(levels: list[DataFrame], ends: DataFrame, arity: int) -> DataFrame:
    """(levels of ``climb``; grp, proof, ... of every group) -> the nodes of the lowest level with their proofs."""
    count = levels[0].count()
    carried = [c for c in ends.columns if c not in ("grp", "proof")]
    above = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        kept = level.columns if depth == 0 else ["grp", "place"]
        kept = [c for c in kept if c not in ("before", "after", "n")]
        here = level.filter("n = 1").select(*kept).join(ends, "grp").select(*kept, *carried, "proof")
        if above is not None:
            step = F.array(F.struct("before", "after"))
            up = above.select(F.col("grp").alias("g"), F.col("place").alias("p"), F.col("proof").alias("rest"), *carried)
            many = level.filter("n > 1").withColumn("up", (F.col("place") / arity).cast("long")).join(up, (F.col("grp") == F.col("g")) & (F.col("up") == F.col("p")))
            here = here.unionByName(many.select(*kept, *carried, F.concat(step, F.col("rest")).alias("proof")))
        if depth == 0:
            return here
        above = settle(here, count // arity**depth, f"proofs-{depth}") if depth % LEVELS_A_STEP == 0 else here


NO_PROOF = "array<struct<before:binary,after:binary>>"


def manifest(docs: DataFrame, values: list[Column], group: Column, order: Column, keep: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """docs -> one row per row of ``docs``, written: the columns of ``keep``, place (of the leaf in its group), leaf,
    subroot and root (hex), and proof (array of the digests before and after the node at each level, as bytes).

    A leaf is H of ``values``. In each group leaves ascend by ``order``, rows without one last, ties by leaf; repeated rows
    are leaves of their own. Columns of ``docs`` may have any names; those of ``keep`` must differ from the other five. While a level has several nodes, every ``arity`` of them become their H, the last ones also
    if they are fewer. A group of null is a group, in front of all others. An empty table gives an empty result."""
    keep = keep or {}
    if clash := {c.lower() for c in keep} & {"place", "leaf", "subroot", "root", "proof"}:
        raise ValueError(f"keep these under other names: {sorted(clash)}")
    names = {c: f"kept_{i}" for i, c in enumerate(keep)}
    leaves = materialize(docs.select(*(v.alias(names[c]) for c, v in keep.items()), group_key(group).alias("grp"), order.alias("ord"), F.unhex(leaf_digest(values)).alias("digest")), "leaves")
    placed = running(leaves, ["grp"], [F.col("ord").asc_nulls_last(), F.col("digest")], name="place", total="n")
    drop_scratch(leaves)
    trees = climb(placed.drop("ord"), arity)
    subroots = materialize(tops(trees), "subroots")
    ranked = running(subroots.withColumn("one", F.lit(0)), ["one"], [F.col("grp")], name="place", total="n")
    upper = climb(ranked.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "place", "n", "digest"), arity)
    root = tops(upper).select("grp", F.col("digest").alias("root"), F.lit(None).cast(NO_PROOF).alias("proof")).withColumn("proof", F.coalesce("proof", F.array().cast(NO_PROOF)))
    ends = materialize(descend(upper, root, arity).select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), "root", "proof"), "subroot-proofs")
    out = descend(trees, ends, arity).select(*(F.col(names[c]).alias(c) for c in keep), "place", in_hex(F.col("digest")).alias("leaf"), in_hex(F.col("subroot")).alias("subroot"), in_hex(F.col("root")).alias("root"), "proof")
    out = materialize(out, "manifest")
    drop_scratch(placed, *trees, subroots, ranked, *upper, ends)
    return out


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents`` by language, and what its proofs say of a copy in which n_chars of some rows is one
    more. Rows without an id, or without n_chars, are never changed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    values = {c: F.col(c) for c in FIELDS}
    changed = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    claimed = F.when(hit, leaf_digest(list(changed.values())))
    m = manifest(docs, list(values.values()), F.col("lang"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "claimed": claimed})
    out = m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), fold(F.coalesce("claimed", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = "list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)), lambda c, b: xor(table_of_crc[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))"


def _sql_fields(n_chars: str) -> str:
    each = (f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in (n_chars if f == "n_chars" else f for f in FIELDS))
    return "sha256(" + " || ".join(each) + ")"


OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT k, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(k AS BIGINT)) AS v FROM range(256) AS r(k)),
d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS grp, {_sql_fields('n_chars')} AS leaf, CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND xor({_CRC}, 4294967295) % 7 = 0 THEN {_sql_fields('n_chars + 1')} END AS claimed FROM documents, (SELECT list(v ORDER BY k) AS table_of_crc FROM crc)),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS LAST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n FROM d),
t AS (SELECT grp, 0 AS level, place, n, leaf AS digest FROM p UNION ALL SELECT grp, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY grp, level, place // 2, n),
s AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS rank, count(*) OVER () AS n_groups FROM t WHERE n = 1),
u AS (SELECT 0 AS level, rank AS place, n_groups AS n, subroot AS digest FROM s UNION ALL SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY level, place // 2, n),
steps AS (
  SELECT p.grp, p.place, t.level, CASE WHEN (p.place >> t.level) & 1 = 1 THEN 'L' ELSE 'R' END AS side, o.digest AS sibling FROM p JOIN t ON t.grp = p.grp AND t.place = p.place >> t.level AND t.n > 1 LEFT JOIN t o ON o.grp = t.grp AND o.level = t.level AND o.place = xor(t.place, 1)
  UNION ALL
  SELECT p.grp, p.place, 100 + u.level, CASE WHEN (s.rank >> u.level) & 1 = 1 THEN 'L' ELSE 'R' END, o.digest FROM p JOIN s ON s.grp = p.grp JOIN u ON u.place = s.rank >> u.level AND u.n > 1 LEFT JOIN u o ON o.level = u.level AND o.place = xor(u.place, 1)),
proofs AS (SELECT grp, place, list(side || coalesce(sibling, '') ORDER BY level) AS steps FROM steps GROUP BY grp, place),
j AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM u WHERE n = 1) AS root, coalesce(p.claimed, p.leaf) AS claimed, coalesce(x.steps, []) AS steps FROM p JOIN s ON s.grp = p.grp LEFT JOIN proofs x ON x.grp = p.grp AND x.place = p.place),
f AS (SELECT *, sha256(array_to_string(list_transform(steps, lambda e: e[2:]), '')) AS proof_sha256, list_reduce(steps, lambda acc, e: sha256(CASE WHEN e[1] = 'L' THEN e[2:] || acc ELSE acc || e[2:] END), claimed) AS folded_root FROM j)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
