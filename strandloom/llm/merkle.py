"""Merkle manifest of a dataset: a tree of hashes for each group, and one over their roots (operator 11).

Leaves are hashed where the rows lie. They are numbered in order by ranges, and each level is a
table: nodes are grouped by tree and place div fanout, a group's sorted children are hashed into
the parent. Proofs are made from the root down: each level's join gives a parent's proof to its
children, who put their own siblings in front, so the rows joined over all levels are as many as
the leaves, not leaves times levels.

Defined results. A null field is hashed as `-`, an empty one as `0:`; null groups are one tree,
which comes first, as null ids do in theirs; rows of one id are leaves of their own, by their
hash, and repeated rows are interchangeable; a group of one row is its own subroot, and a single
group's subroot is hashed no further; a text of any length is hashed whole; an empty table gives no row; other
columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.prefix import before

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels on the way down whose joins make one plan; then the nodes are written.
STRETCH = 4
_STEP = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the concatenated values, each `-` if null, else its UTF-8 byte count, `:` and itself."""

    def spelled(c: Column) -> Column:
        c = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.sha2(F.concat(*map(spelled, values)), 256)


def folded(leaf: Column | str, proof: Column | str) -> Column:
    """The root that a leaf and its proof lead to."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(proof, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(proof: Column | str) -> Column:
    """The hashes of a proof in one string, from leaf to root, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def climb(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels above leaves (tree, place, size, hash, row): written tables of tree, place, size, hash, children.

    size is the number of nodes of the tree on that level; a node whose size is 1 is a root.
    """
    levels, nodes = [], leaves
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        child = F.struct("place", "hash", *(["row"] if nodes is leaves else []))
        parent = [F.col("tree"), F.expr(f"place div {fanout}").alias("place")]
        groups = nodes.where("size > 1").groupBy(*parent).agg(F.expr(f"(max(size) + {fanout - 1}) div {fanout}").alias("size"), F.sort_array(F.collect_list(child)).alias("children"))
        nodes = store.stored(groups.withColumn("hash", F.sha2(F.array_join("children.hash", ""), 256)), "level")
        levels.append(nodes)
        most = -(-most // fanout)
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, hash): the root of every tree."""
    out = leaves.where("size = 1").select("tree", "hash")
    for level in levels:
        out = out.unionByName(level.where("size = 1").select("tree", "hash"))
    return out


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """hash, row, proof and the columns of tops for every leaf; tops: one row a tree with the proof of its root."""
    carried = [c for c in tops.columns if c not in ("tree", "proof")]
    known = None
    for k in reversed(range(len(levels))):
        level = levels[k].select("tree", "place", "size", "children")
        paired = level.where("size = 1").join(tops, "tree")
        if known is not None:
            paired = paired.unionByName(level.where("size > 1").join(known, ["tree", "place"]))
        each = paired.select("tree", "proof", *carried, "children", F.posexplode("children").alias("at", "child"))
        step = F.struct(F.array_join(F.slice("children.hash", F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.slice("children.hash", F.col("at") + 2, F.size("children")), "").alias("right"))
        own = ["child.place"] if k else ["child.hash", "child.row"]
        known = each.select("tree", *own, F.concat(F.array(step), "proof").alias("proof"), *carried)
        if k and k % STRETCH == 0:
            known = store.stored(known, "proofs")
    alone = leaves.where("size = 1").join(tops, "tree").select("tree", "hash", "row", "proof", *carried)
    return alone if known is None else known.unionByName(alone)


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 2, presented: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof (from the leaf up), presented.

    presented has new values for some fields, as a copy of the data to be checked would: the
    column presented is the hash of the leaf with them, null where nothing differs.
    """
    if fanout < 2:
        raise ValueError("a node needs two children or more")
    leaf = digest(*[F.col(c) for c in fields])
    other = digest(*[(presented or {}).get(c, F.col(c)) for c in fields])
    same = F.lit(True)
    for c, new in (presented or {}).items():
        same = same & new.cast("string").eqNullSafe(F.col(c).cast("string"))
    hashed = docs.select(F.col(group_col).alias("name"), F.col(id_col).alias("id"), leaf.alias("hash"), F.when(~same, other).alias("presented"))
    placed = store.stored(before(store.stored(hashed, "leaves"), [F.col("name").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("hash")], n=None), "numbered")

    # a tree is known by the number of its first leaf, which follows the order of the names
    trees = placed.groupBy(F.col("name").alias("of")).agg(F.min("n").alias("tree"), F.count(F.lit(1)).alias("size"))
    row = F.struct(F.col("id"), F.col("presented")).alias("row")
    leaves = store.stored(placed.join(store.stored(trees, "trees"), F.col("name").eqNullSafe(F.col("of"))).select("tree", (F.col("n") - F.col("tree")).alias("place"), "size", "hash", row), "leaves")
    levels = climb(leaves, fanout)

    found = store.stored(roots(leaves, levels), "subroots")
    n_trees = found.count()
    heads = store.stored(before(found, [F.col("tree")], n=None).select(F.lit(0).cast("long").alias("tree"), F.col("n").alias("place"), F.lit(n_trees).cast("long").alias("size"), "hash", F.struct(F.col("tree").alias("tree")).alias("row")), "heads")
    above = climb(heads, fanout)
    top = roots(heads, above).withColumn("proof", F.array().cast(_STEP)).select("tree", "proof", F.col("hash").alias("root"))
    tops = descend(heads, above, top).select("row.tree", "proof", F.col("hash").alias("subroot"), "root")
    out = descend(leaves, levels, store.stored(tops, "tops"))
    return out.select(F.col("row.id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", "proof", F.col("row.presented").alias("presented"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    more = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))  # wide enough for the greatest long
    found = merkle_manifest(docs, presented={"n_chars": more})
    found = found.withColumn("folded_root", folded(F.coalesce("presented", "leaf"), "proof"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("proof"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384)))) AS crc
  FROM documents),
leaves AS (
  SELECT row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, *,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size
  FROM (SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
      CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256(head || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || tail) END AS changed FROM d)),
nodes AS (
  SELECT 0 AS level, lang, place, size, leaf AS hash FROM leaves
  UNION ALL
  SELECT max(level) + 1, lang, place // 2, (max(size) + 1) // 2, sha256(string_agg(hash, '' ORDER BY place)) FROM nodes WHERE size > 1 GROUP BY lang, place // 2),
heads AS (SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, place, size, subroot AS hash FROM heads
  UNION ALL
  SELECT max(level) + 1, place // 2, (max(size) + 1) // 2, sha256(string_agg(hash, '' ORDER BY place)) FROM tops WHERE size > 1 GROUP BY place // 2),
steps AS (
  SELECT l.id, n.level AS step, (l.place >> n.level) AS at, s.hash AS sibling
  FROM leaves l JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.place = l.place >> n.level AND n.size > 1
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM n.lang AND s.level = n.level AND s.place = xor(n.place, 1)
  UNION ALL
  SELECT l.id, 1000 + n.level, (h.place >> n.level), s.hash
  FROM leaves l JOIN heads h ON h.lang IS NOT DISTINCT FROM l.lang JOIN tops n ON n.place = h.place >> n.level AND n.size > 1
    LEFT JOIN tops s ON s.level = n.level AND s.place = xor(n.place, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step) AS k FROM steps),
folds AS (
  SELECT id, 1 AS k, coalesce(changed, leaf) AS acc FROM leaves
  UNION ALL
  SELECT f.id, f.k + 1, sha256(CASE WHEN n.at % 2 = 1 THEN coalesce(n.sibling, '') || acc ELSE acc || coalesce(n.sibling, '') END)
  FROM folds f JOIN numbered n ON n.id = f.id AND n.k = f.k),
proofs AS (SELECT id, string_agg(coalesce(sibling, ''), '' ORDER BY k) AS proof FROM numbered GROUP BY id)
SELECT l.doc_id, l.leaf, h.subroot, t.hash AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.acc AS folded_root, f.acc = t.hash AS verified
FROM leaves l JOIN heads h ON h.lang IS NOT DISTINCT FROM l.lang JOIN tops t ON t.size = 1
  LEFT JOIN proofs p ON p.id = l.id JOIN (SELECT id, arg_max(acc, k) AS acc FROM folds GROUP BY id) f ON f.id = l.id
"""
