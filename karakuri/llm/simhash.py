"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.llm.common import cut, table
from karakuri.llm.components import star_components

BYTES, MAX_BITS = 8, 2
#: Two fingerprints that differ in at most MAX_BITS bits agree in at least so many of their positional bytes.
MIN_SHARED = BYTES - MAX_BITS
#: The byte positions in pairs. MAX_BITS flipped bits spoil that many pairs at most, so two pairs are left unchanged.
PAIRS = [(0, 1), (2, 3), (4, 5), (6, 7)]
#: Lists of more fingerprints than this are posted once more, under two more of their bytes.
LONG = 512


def _mask(positions) -> int:
    """The bytes at these positions as a signed 64-bit mask."""
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


#: The positions of each posting key: every two of the pairs.
KEYS = [a + b for a, b in combinations(PAIRS, 2)]


def fingerprint_of(text: bytes | None, shingle: int = 3) -> bytes:
    """Majority SimHash of the shingles' XXH64 (seed 42), as 8 big-endian bytes."""
    import numpy as np
    from xxhash import xxh64_digest

    tokens = (text or b"").lower().split()  # bytes.lower changes A-Z only; bytes.split cuts at 09-0D and 20
    if not tokens:
        return bytes(BYTES)
    if len(tokens) < shingle:
        return xxh64_digest(b" ".join(tokens), 42)
    ones, n, step = np.zeros(64, np.int64), len(tokens) - shingle + 1, 65536
    for at in range(0, n, step):
        part = tokens[at : at + step + shingle - 1]
        found = b"".join([xxh64_digest(b" ".join(x), 42) for x in zip(*(part[k:] for k in range(shingle)))])
        ones += np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long; null and blank texts have fingerprint 0."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [int.from_bytes(fingerprint_of(t.as_py(), shingle), "big", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _near(a, b):
    """Which pairs of fingerprints share MIN_SHARED positional bytes at least (the tally) and, of these, are within MAX_BITS bits."""
    import numpy as np

    diff = np.ascontiguousarray(a ^ b)
    shared = (diff.view(np.uint8).reshape(*diff.shape, BYTES) == 0).sum(axis=-1)
    near = shared >= MIN_SHARED
    near[near] = np.bitwise_count(diff[near].view(np.uint64)) <= MAX_BITS
    return near


def _link(members) -> list[tuple[int, int]]:
    """Links of one posting list as a spanning forest.

    Short lists tally the shared positional bytes of their pairs. Longer ones agree in MIN_SHARED positions (they were
    posted under so many), so their members differ in MAX_BITS bytes at most, and each looks up its neighbours at one
    and two flipped bits of those bytes: the same links, and work in proportion to the list.
    """
    import numpy as np

    x = np.unique(np.asarray(members, np.int64))
    n = len(x)
    if n <= LONG:
        at, to = np.nonzero(_near(x[:, None], x[None, :]))
    else:
        free = [np.int64(_signed(1 << k)) for k in range(64) if int(np.bitwise_or.reduce(x ^ x[0])) >> k & 1]
        flips = [*free, *(p | q for p, q in combinations(free, 2))]
        pairs = []
        for f in flips:
            y = x ^ f
            k = np.minimum(np.searchsorted(x, y), n - 1)
            hit = np.nonzero(x[k] == y)[0]
            pairs.append((hit, k[hit]))
        at, to = (np.concatenate(p) for p in zip(*pairs))
    label = np.arange(n)
    while True:  # smallest reachable member, by hooking and pointer jumping
        low = label.copy()
        np.minimum.at(low, at, label[to])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(x[i]), int(x[r])) for i, r in enumerate(label) if i != r]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(batches):
    """Arrow batches of posting lists -> batches of their links."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        column = batch.column(0)
        flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        two = ends - starts == 2
        a, b = flat[starts[two]], flat[starts[two] + 1]
        near = _near(a, b)
        found = [(int(p), int(q)) for p, q in zip(a[near], b[near])]
        for s, e in zip(starts[~two], ends[~two]):
            found += _link(flat[s:e])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b) pairs that connect just what fingerprints within MAX_BITS bits connect.

    The index holds each fingerprint under the bytes at every two of the four pairs of positions: two fingerprints
    within MAX_BITS bits meet in one list at least. In a list the shared positional bytes of its pairs are tallied;
    those with fewer than MIN_SHARED go, the others are verified. A list of more than LONG members is not compared but
    posted anew under every two more of its bytes, where two near members meet again, and where a list holds
    2**(8 * MAX_BITS) fingerprints at most.
    """
    parts = max(8, -(-fps.count() // 100_000))  # a few bytes become many postings: what is read is no measure of the work

    def posted(df, keys):
        under = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.col("fp").bitwiseAND(F.lit(_mask(k))).alias("key")) for i, k in enumerate(keys)]))
        return df.select("fp", under.alias("k")).select("fp", "k.p", "k.key")

    short = posted(fps.repartition(parts, "fp"), KEYS)
    hot = short.groupBy("p", "key").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("p", "key")
    hot = cut(hot)  # (p, key) of the few long lists
    lists = short.join(hot, ["p", "key"], "left_anti").groupBy("p", "key").agg(F.collect_list("fp").alias("fps"))
    deeper = [(i, set(k) | set(two)) for i, k in enumerate(KEYS) for two in combinations(sorted(set(range(BYTES)) - set(k)), MIN_SHARED - len(k))]
    again = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(j).alias("q"), F.col("fp").bitwiseAND(F.lit(_mask(k))).alias("key")) for j, (i, k) in enumerate(deeper)])
    long_ = (
        short.join(hot, ["p", "key"], "left_semi")
        .select("fp", "p", F.explode(again).alias("k")).where("k.p = p")
        .groupBy("k.q", "k.key").agg(F.collect_list("fp").alias("fps"))
    )
    every = lists.select("fps").unionByName(long_.select("fps")).where(F.size("fps") > 1)
    return every.mapInArrow(_linked, "a bigint, b bigint").distinct()


def rooted_classes(prints: DataFrame, low) -> DataFrame:
    """(fp, low, root) for every distinct fingerprint of prints: low (an aggregate), and its component's smallest one."""
    classes = cut(prints.groupBy("fp").agg(low.alias("low")))
    stars = star_components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    return cut(classes.join(stars, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most MAX_BITS differing bits.

    Rows with equal fingerprints form one class, so a group of copies of any size is one node of the graph. A null text
    counts as empty (fingerprint 0, linked like any other), repeated rows stay, rows with a null id stay and get the
    component of their class (null if no row of it has an id), texts of any length are read whole, an empty table gives
    an empty result, other columns are ignored whatever their names.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    rooted = rooted_classes(prints, F.min("id"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lows, "root").select("fp", "component")
    return prints.join(named, "fp").select("id", "fp", "component")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def node_of(id_col: str = "doc_id", text_col: str = "text"):
    """What tells rows of documents apart, and orders them: by id, those without one last, and 64 bits of the text's hash."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))


def group_heads(docs: DataFrame) -> DataFrame:
    """(node): the least node of each group of near-duplicates among documents (doc_id, text)."""
    prints = cut(fingerprints(docs.select(node_of().alias("node"), "text"), "node"))
    rooted = rooted_classes(prints, F.min("id"))
    return rooted.groupBy("root").agg(F.min("low").alias("node")).select("node")


def rows_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of documents that are among the nodes, those that are equal in id and text once."""
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), node_of().alias("node"))
    return rows.join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("_doc.*")


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest id, one without an id only if none has any.

    Rows are told apart by id and text (64 bits of its hash), so a row goes or stays by its own text even if its id
    repeats; rows equal in both stay once. A null text counts as empty; an empty table stays empty; columns keep their
    names and order.
    """
    return rows_of(docs, group_heads(docs))
