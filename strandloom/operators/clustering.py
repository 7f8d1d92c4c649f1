"""Similarity clustering and matching of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as seq
from strandloom.operators.graph import both_ways
from strandloom.operators.numbering import numbered
from strandloom.session import forget, stored


def similar_pairs(seqs: DataFrame, identity: float, identity_of=seq.identity_by_min, lengths: float | None = None) -> DataFrame:
    """(a, b, identity) with a < b of (ord, sequence) whose positional identity is at least identity.

    lengths: the least share that the shorter length has of the longer; identity, if not given.

    With L the shorter length, at most m = (1-t)L places differ, so of m+1 blocks at fixed
    places one is equal: an equality join on (block width, block number, block text). Lengths
    are within that share of each other, so each row takes part in the few width classes that
    its partners can have.
    """
    t = identity
    share = identity if lengths is None else lengths
    rows = seqs.where(F.length("sequence") > 0).select("ord", "sequence", F.length("sequence").cast("int").alias("n"))

    def width(n):
        """Block width for a shorter length n: the largest w with floor(n / w) > m."""
        return F.greatest(F.lit(1), F.floor(n / (F.floor((1 - t) * n + 1e-9) + 1))).cast("int")

    least = F.ceil(F.col("n") * share - 1e-9).cast("int")
    widths = F.array_distinct(F.transform(F.sequence(F.greatest(least, F.lit(1)), F.col("n")), lambda n: width(n)))
    keyed = rows.withColumn("w", F.explode(widths))
    keyed = keyed.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("n") / F.col("w")).cast("int") - 1, F.lit(0)))))
    keyed = keyed.select("ord", "n", "w", "block", F.substring("sequence", F.col("block") * F.col("w") + 1, F.col("w")).alias("text"))
    meets = keyed.withColumnsRenamed({"ord": "a", "n": "na"}).join(keyed.withColumnsRenamed({"ord": "b", "n": "nb"}), ["w", "block", "text"])
    ok = (F.col("a") < F.col("b")) & (F.abs(F.col("na") - F.col("nb")) / F.greatest("na", "nb") <= 1 - share + 1e-12) & (F.col("w") == width(F.least("na", "nb")))
    pairs = meets.where(ok).select("a", "b").distinct()
    s = rows.select("ord", "sequence")
    both = pairs.join(s.withColumnsRenamed({"ord": "a", "sequence": "sa"}), "a").join(s.withColumnsRenamed({"ord": "b", "sequence": "sb"}), "b")
    return both.select("a", "b", identity_of(F.col("sa"), F.col("sb")).alias("identity")).where(F.col("identity") >= t)


def first_independent(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord) of those rows that a pass in ord order takes: a row is taken if none of its earlier partners was.

    pairs(a, b), a < b. A row without an undecided earlier partner is taken, and its later
    partners go. In between, a row with a single undecided earlier partner is taken exactly if
    that one isn't; such rows form trees, and pointer doubling brings each to its tree's root with
    the parity of its steps. Roots that are decided then decide their whole tree, so a chain
    costs the logarithm of its length. Where every row has several undecided earlier partners
    (a band, rather than a chain), a round decides the rows that the one before set free.
    """
    left = stored(rows.select("ord"), "left")
    taken = left.limit(0)
    pairs = stored(pairs.select("a", "b"), "live")
    while not left.isEmpty():
        before = pairs.groupBy(F.col("b").alias("ord")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("at"))
        # root: the row where the walk stands; odd: its steps are an odd number
        state = left.join(before, "ord", "left").select("ord", F.coalesce("n", F.lit(0)).alias("n"), "at")
        walks = stored(state.select("ord", F.when(F.col("n") == 1, F.col("at")).otherwise(F.col("ord")).alias("at"), (F.col("n") == 1).alias("odd"), (F.col("n") == 1).alias("goes"), (F.col("n") == 0).alias("free")), "walks")
        while not walks.where("goes").isEmpty():
            ahead = walks.select(F.col("ord").alias("at"), F.col("at").alias("at2"), F.col("odd").alias("odd2"), F.col("goes").alias("goes2"), F.col("free").alias("free2"))
            moved = walks.where("goes").join(ahead, "at").select("ord", F.col("at2").alias("at"), (F.col("odd") != F.col("odd2")).alias("odd"), F.col("goes2").alias("goes"), F.col("free2").alias("free"))
            last, walks = walks, stored(walks.where("not goes").unionByName(moved), "walks")
            forget(last)
        decided = walks.where("free")
        new = stored(decided.where("not odd").select("ord"), "taken")
        taken = taken.unionByName(new)
        beaten = pairs.join(new.withColumnRenamed("ord", "a"), "a", "left_semi").select(F.col("b").alias("ord"))
        gone = stored(decided.select("ord").unionByName(beaten).distinct(), "gone")
        left = stored(left.join(gone, "ord", "left_anti"), "left")
        last, pairs = pairs, stored(pairs.join(gone.withColumnRenamed("ord", "a"), "a", "left_anti").join(gone.withColumnRenamed("ord", "b"), "b", "left_anti").select("a", "b"), "live")
        forget(last, walks)
    return taken


def greedy_clusters(seqs: DataFrame, identity: float, lengths: float | None = None) -> DataFrame:
    """(ord, cluster_id, centroid) of (ord, sequence): greedy incremental clustering without a scan in order.

    Equal sequences are folded into their first row, so copies make no pairs. The centroids of
    the sequential pass are the first maximal independent set in ord order (first_independent());
    the others are members. A member, copy or not, goes to the most similar centroid before it, the
    latest of equal ones. Empty sequences are left out.
    """
    rows = stored(seqs.where(F.length("sequence") > 0).select("ord", F.xxhash64("sequence").alias("h"), F.sha2("sequence", 256).alias("digest")), "rows")
    first = rows.groupBy("h", "digest").agg(F.min("ord").alias("one"))
    rows = stored(rows.join(first, ["h", "digest"]).select("ord", "one"), "rows")
    ones = seqs.select("ord", "sequence").join(rows.where("ord = one").select("ord"), "ord", "left_semi")
    pairs = stored(similar_pairs(ones, identity, lengths=lengths), "pairs")
    central = stored(first_independent(rows.where("ord = one").select("ord"), pairs.select("a", "b")), "centroids")
    named = stored(numbered(central, [F.col("ord")], "__n").select("ord", F.concat(F.lit("cluster_"), F.col("__n").cast("string")).alias("cluster_id")), "named")
    # a copy may lie behind centroids that came after its sequence's first row
    both = pairs.select(F.col("b").alias("one"), F.col("a").alias("centroid"), "identity").unionByName(pairs.select(F.col("a").alias("one"), F.col("b").alias("centroid"), "identity"))
    near = both.unionByName(central.select(F.col("ord").alias("one"), F.col("ord").alias("centroid"), F.lit(1.0).alias("identity")))
    near = near.join(named.withColumnRenamed("ord", "centroid"), "centroid")
    best = rows.join(near, "one").where((F.col("centroid") < F.col("ord")) | (F.col("centroid") == F.col("ord")))
    chosen = best.groupBy("ord").agg(F.max_by(F.struct("cluster_id", "centroid"), F.struct(F.col("centroid") == F.col("ord"), "identity", "centroid")).alias("c"))
    return chosen.select("ord", "c.cluster_id", "c.centroid")


def best_match(queries: DataFrame, centroids: DataFrame, identity: float) -> DataFrame:
    """(query_id, cluster_id, identity) of the most similar centroid at or above the threshold.

    queries(query_id, sequence), centroids(cluster_id, sequence); identity over the longer
    length, case aside. The first cluster id wins a tie. Blocks as in similar_pairs, over the
    longer length: at most (1-t) of it differ, length difference included.
    """
    def keyed(df: DataFrame, key: str, role: str) -> DataFrame:
        n = F.length("sequence")
        up = F.upper("sequence")
        rows = df.where(n > 0).select(F.col(key).alias(role), up.alias(f"s{role}"), n.cast("int").alias(f"n{role}"))
        longest = F.floor(F.col(f"n{role}") / identity + 1e-9).cast("int")
        w = F.explode(F.array_distinct(F.transform(F.sequence(F.col(f"n{role}"), longest), lambda m: _width(m, identity))))
        rows = rows.withColumn("w", w)
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col(f"n{role}") / F.col("w")).cast("int") - 1, F.lit(0)))))
        return rows.withColumn("text", F.substring(f"s{role}", F.col("block") * F.col("w") + 1, F.col("w")))

    q, c = keyed(queries, "query_id", "q"), keyed(centroids, "cluster_id", "c")
    pairs = q.drop("sq").join(c.drop("sc"), ["w", "block", "text"]).where(F.col("w") == _width(F.greatest("nq", "nc"), identity)).select("q", "c").distinct()
    full = pairs.join(queries.select(F.col("query_id").alias("q"), F.col("sequence").alias("sq")), "q").join(centroids.select(F.col("cluster_id").alias("c"), F.col("sequence").alias("sc")), "c")
    scored = full.select("q", "c", seq.identity_by_max(F.col("sq"), F.col("sc")).alias("identity")).where(F.col("identity") >= identity)
    return scored.groupBy(F.col("q").alias("query_id")).agg(F.min_by(F.struct("c", "identity"), F.struct(-F.col("identity"), "c")).alias("m")).select("query_id", F.col("m.c").alias("cluster_id"), F.col("m.identity").alias("identity"))


def _width(n, t: float):
    """Largest width whose blocks inside the shorter sequence outnumber the differing places."""
    differ = F.floor((1 - t) * n + 1e-9)
    return F.greatest(F.lit(1), F.floor(F.ceil(n * t - 1e-9) / (differ + 1))).cast("int")


def bucket_pairs(seqs: DataFrame, prefix: int = 4, width: int = 100) -> DataFrame:
    """(a, b) of (cluster_id, sequence) with one length class and one beginning, a < b."""
    key = [F.floor(F.length("sequence") / width).alias("size"), F.rpad(F.substring("sequence", 1, prefix), prefix, "0").alias("head")]
    k = seqs.select("cluster_id", *key)
    return k.withColumnRenamed("cluster_id", "a").join(k.withColumnRenamed("cluster_id", "b"), ["size", "head"]).where("a < b").select("a", "b")


def sharing_a_neighbour(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that have a neighbour in common."""
    n = both_ways(edges).distinct()
    common = pairs.join(n.withColumnRenamed("id", "a"), "a").join(n.withColumnRenamed("id", "b"), ["b", "nbr"])
    return common.select(*pairs.columns).distinct()


def pair_identities(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """(a, b, coverage, identity): by edit distance; computed once and used for every threshold."""
    s = seqs.select("cluster_id", "sequence")
    both = pairs.join(s.withColumnsRenamed({"cluster_id": "a", "sequence": "sa"}), "a").join(s.withColumnsRenamed({"cluster_id": "b", "sequence": "sb"}), "b")
    return both.select("a", "b", seq.coverage(F.col("sa"), F.col("sb")).alias("coverage"), seq.global_identity(F.col("sa"), F.col("sb")).alias("identity"))


def alignment_rows(members: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, name, sequence) for an aligner: each genome's first member, equal sequences once.

    members(cluster_id, genome_id, line_idx, sequence); a cluster without members gives its
    centroid; clusters with fewer than two sequences go.
    """
    first = members.where(F.length("sequence") > 0).groupBy("cluster_id", "genome_id").agg(F.min_by("sequence", F.struct("line_idx", "sequence")).alias("sequence"))
    once = first.groupBy("cluster_id", "sequence").agg(F.min("genome_id").alias("name"))
    bare = centroids.join(once.select("cluster_id").distinct(), "cluster_id", "left_anti").select("cluster_id", F.col("cluster_id").alias("name"), "sequence")
    rows = once.select("cluster_id", "name", "sequence").unionByName(bare)
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cluster_id"))).where("n >= 2").drop("n")


def kept_columns(alignment: DataFrame, most_gaps: float) -> DataFrame:
    """(cluster_id, name, sequence) with the columns whose share of gaps is at most most_gaps."""
    chars = alignment.select("cluster_id", "name", F.posexplode(F.split("sequence", "")).alias("at", "c")).where("c <> ''")
    gaps = chars.groupBy("cluster_id", "at").agg((F.count_if(F.col("c") == "-") / F.count(F.lit(1))).alias("gaps"))
    kept = chars.join(gaps.where(F.col("gaps") <= most_gaps), ["cluster_id", "at"])
    return kept.groupBy("cluster_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]), "").alias("sequence"))
