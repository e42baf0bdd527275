"""Near copies by their five-word shingles: MinHash bands tell which documents can have any, a prefix filter finds the
pairs, and exact Jaccard similarity decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.llm.common import cut, removed, shuffles_freed, written
from karakuri.llm.simhash import group_heads, node_of, rows_of

#: Words in a shingle, and the Jaccard similarity from which a document is a copy, as a fraction.
SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5
#: A pair of that similarity shares none of the bands with a chance of (1 - 0.8**5)**40, about 1e-7.
BANDS, ROWS = 40, 5
#: The documents of each list that the others are compared with grow by this factor from round to round.
GROWTH = 16
_P = 0x9E3779B97F4A7C15


def shingles_of(text: bytes | None, known: dict | None = None):
    """The distinct hashes of a text's shingles (of XXH64 word hashes); a shorter text is one shingle, a blank one has none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    w = np.fromiter((known[t] if t in known else known.setdefault(t, xxh64_intdigest(t)) for t in tokens), np.uint64, len(tokens))
    if len(known) > 200_000:
        known.clear()
    k = min(SHINGLE, len(tokens))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_P) + w[j : len(w) - k + 1 + j]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_P)
    return np.unique(h ^ (h >> np.uint64(32)))


def bands_of(shingles):
    """One signed long for each band of a set's MinHash signature."""
    import numpy as np

    if not len(shingles):
        return np.zeros(0, np.int64)
    random = np.random.default_rng(5)
    factors, added = (random.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32) for _ in range(2))
    factors |= np.uint32(1)
    x, low = shingles.astype(np.uint32), np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (factors[:, None] * x[None, at : at + 1024] + added[:, None]).min(axis=1))
    h = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_P) + column
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _mapped(nodes: DataFrame, f, name: str) -> DataFrame:
    """(node, name): f of each node's shingles, an array of longs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known: dict = {}
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [np.asarray(f(shingles_of(t.as_py(), known))).view(np.int64) for t in texts]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", name])

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.select("node", "text").mapInArrow(run, f"node {kind}, {name} array<bigint>")


def _postings(sets: DataFrame) -> DataFrame:
    """(key, node, n, at): each set (node, s) under the shingles of its prefix that other sets have too.

    With its n shingles ordered from the rarest, a set shares one of its first n - ceil(0.8 n) + 1 with every similar
    one. Shingles of one set only come first and are counted, not posted. at: the place of the shingle in that order.
    """
    grams = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("key"))
    often = grams.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1")
    ranked = grams.join(often, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "key"))).alias("r"))
    prefix = F.col("n") - F.floor((F.col("n") * NUMERATOR + (DENOMINATOR - 1)) / DENOMINATOR) + 1
    alone = F.col("n") - F.size("r")
    kept = ranked.where(alone < prefix).select("node", "n", alone.alias("alone"), F.slice("r", 1, (prefix - alone).cast("int")).alias("r"))
    return kept.select("node", "n", "alone", F.posexplode("r").alias("k", "x")).select(F.col("x.key").alias("key"), "node", "n", (F.col("alone") + F.col("k")).alias("at"))


def copies(nodes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(node): the rows of nodes (node, text) to leave out, so that no two that stay have similar shingle sets.

    only: (node), the rows that count. In each round the leaders of a list of postings are compared with its other
    members, if sizes and places allow for enough shared shingles. The greater node of a similar pair goes, and a leader
    is done with its list; rounds end when no list has two members left, so every pair of a list that stays was compared.
    Tables between steps are written to the shared folder and deleted at the end; shuffle files go after each step.
    """
    spark, paths = nodes.sparkSession, []

    def kept(df, name="copies"):
        table, path = written(df, name)
        paths.append(path)
        return table

    several = lambda df: df.join(df.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "key", "left_semi")
    with shuffles_freed(spark):
        mapped = _mapped(nodes, bands_of, "keys")
        mapped = mapped if only is None else mapped.join(only, "node", "left_semi")
        bands = kept(mapped.select("node", F.explode("keys").alias("key")).distinct())
        some = kept(several(bands).select("node").distinct())
        sets = kept(_mapped(nodes.join(some, "node", "left_semi").dropDuplicates(["node"]), lambda x: x, "s"))
        alive = kept(several(kept(_postings(sets))))
        gone, salts = some.limit(0), 1
        while not alive.isEmpty():
            salt = F.pmod(F.xxhash64("node"), F.lit(salts))
            leaders = alive.groupBy("key", salt.alias("salt")).agg(F.min(F.struct("node", "n", "at")).alias("a")).select("key", "a.*")
            leaders = kept(leaders.select("key", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "at")]))
            least = (F.col("n") + F.col("_n")) * NUMERATOR  # shared shingles needed, times NUMERATOR + DENOMINATOR
            can = (F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) * (NUMERATOR + DENOMINATOR) >= least) & (F.least("n", "_n") * DENOMINATOR >= F.greatest("n", "_n") * NUMERATOR)
            pairs = alive.join(leaders, "key").where((F.col("node") != F.col("_node")) & can).select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
            both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
            same = F.size(F.array_intersect("sa", "sb"))
            similar = same * DENOMINATOR >= (F.size("sa") + F.size("sb") - same) * NUMERATOR
            found = kept(both.where(similar).select(F.col("b").alias("node")).distinct())
            gone, salts = gone.unionByName(found), salts * GROWTH
            left = alive.join(found, "node", "left_anti").join(leaders.select("key", F.col("_node").alias("node")), ["key", "node"], "left_anti")
            alive = kept(several(left))
        out = cut(gone.distinct())
    removed(spark, *paths)
    return out


def near_copy_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (near_duplicate_stage), and of these one of each group whose
    five-word shingles are similar.

    The smallest id stays, one without an id only if no other does. Blank texts have no shingles and are not compared;
    rows are told apart by id and text, so repeated ids and null ids are judged each by their own text; an empty table
    stays empty; columns keep their names and order, texts of any length are read whole.
    """
    with shuffles_freed(spark):
        heads = cut(group_heads(docs))
    named = docs.select(node_of().alias("node"), F.col("text").cast("string").alias("text"))
    return rows_of(docs, heads.join(copies(named, heads), "node", "left_anti"))
