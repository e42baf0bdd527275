"""Sharding by histogram sort: exact byte counts below refined key boundaries, then one exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karakuri.llm.common import cut, table

#: The key's digits from the left: bits of the text's hash, then of the row's hash, which splits groups of equal texts.
DIGITS = [(0, 12), *[(0, 8)] * 6, (0, 4), *[(1, 8)] * 8]
#: How far the bytes below a shard's boundary may be from the even share, in shares.
TOLERANCE = 0.001
#: A group of equal texts is parted only if a boundary beside it would be off by more than so many tolerances.
GROUP_TOLERANCES = 20
#: Rows of one shard are numbered in parts of about this many bytes, however many parts that makes.
PART_BYTES = 8 << 20
#: Tasks that number parts, at most; each takes several parts if there are more.
TASKS = 100_000
#: The heavy prefixes are broadcast up to this many; beyond it rows are shuffled to them.
BROADCAST_HEAVY = 100_000
_MIN, _ONES = -(1 << 63), (1 << 64) - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row, _k0 and _k1 (hashes of text and id, their sign flipped so that bits sort as unsigned) and _size."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.xxhash64(text).bitwiseXOR(F.lit(_MIN)).alias("_k0"),
        F.xxhash64(F.col(id_col)).bitwiseXOR(F.lit(_MIN)).alias("_k1"),
        (F.octet_length(text).cast("long") + 1).alias("_size"),
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def find_splitters(keys: DataFrame, targets: list[tuple[float, float]]) -> list[tuple[int, int, int, int]]:
    """For each (bytes, allowed error): a boundary (k0, k1, exact bytes below, exact rows below), keys as unsigned.

    Each round counts bytes and rows per next digit inside the key ranges that still hold an unmet target, and keeps
    the range or boundary for each. Boundaries between whole groups of equal texts are probed before those inside one.
    """
    found: list = [None] * len(targets)
    # range of each open target: (bits of k0, k0 prefix, bits of k1, k1 prefix) and bytes and rows below it
    open_ = {j: ((0, 0, 0, 0), 0, 0) for j in range(len(targets))}
    for which, width in DIGITS:
        if not open_:
            break
        ranges = sorted({v[0] for v in open_.values()})
        number = {v: i for i, v in enumerate(ranges)}
        b0, _, b1, _ = ranges[0]  # all open ranges are equally deep
        within = keys.withColumn("r", F.lit(0))
        if b0:
            prefix = [F.shiftrightunsigned("_k0", 64 - b0).alias("p0"), (F.shiftrightunsigned("_k1", 64 - b1) if b1 else F.lit(0).cast("long")).alias("p1")]
            known = keys.sparkSession.createDataFrame([(i, _signed(p0), _signed(p1)) for i, (_, p0, _, p1) in enumerate(ranges)], "r int, p0 bigint, p1 bigint")
            within = keys.select("*", *prefix).join(F.broadcast(known), ["p0", "p1"])  # a row for each open target at most
        bits = ranges[0][2 * which]
        digit = F.shiftrightunsigned(f"_k{which}", 64 - bits - width).bitwiseAND(F.lit((1 << width) - 1))
        counts: dict[int, list] = {}
        for r in within.select("r", digit.alias("d"), "_size").groupBy("r", "d").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect():
            counts.setdefault(r["r"], []).append((r["d"], r["b"], r["n"]))
        for x in counts.values():
            x.sort()
        still = {}
        for j, ((b0, p0, b1, p1), below, rows) in open_.items():
            target, allowed = targets[j]
            for d, b, n in counts.get(number[b0, p0, b1, p1], []):
                deeper = (b0 + width, p0 << width | d, b1, p1) if which == 0 else (b0, p0, b1 + width, p1 << width | d)
                start = (deeper[1] << (64 - deeper[0]), deeper[3] << (64 - deeper[2]) if deeper[2] else 0)
                if abs(below - target) <= allowed or below >= target:
                    found[j] = (*start, below, rows)
                    break
                near = min(target - below, below + b - target)
                whole = n == 1 or which == 0 and deeper[0] == 64 and near <= GROUP_TOLERANCES * allowed
                if whole and below + b > target + allowed:  # a single row, or a group: the nearer of its two sides
                    if below + b - target < target - below:
                        up = (deeper[1] + 1 << (64 - deeper[0]), 0) if which == 0 else (start[0], deeper[3] + 1 << (64 - deeper[2]))
                        found[j] = (min(up[0], _ONES), min(up[1], _ONES), below + b, rows + n)
                    else:
                        found[j] = (*start, below, rows)
                    break
                if below + b > target + allowed:
                    still[j] = (deeper, below, rows)
                    found[j] = (*start, below, rows)  # the best so far, should the digits end
                    break
                below, rows = below + b, rows + n
            else:
                found[j] = (_ONES, _ONES, below, rows) if not b0 else found[j]
        open_ = still
    return found


def histogram_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """docs plus size, shard (0 to shards - 1) and slot (0, 1, ... within the shard), near equal in bytes.

    size is the text's UTF-8 bytes plus 1 (a null text has none). Shards are ranges of the hash of the text, then of the
    id, so equal texts are neighbours, and part only where a shard would else be off by over GROUP_TOLERANCES tolerances.
    Within a shard slots follow the first bits of the text's hash; where these have more than two parts' bytes, as
    large groups of equal texts do, they follow as many bits of the id's hash, too, as make it parts. The driver holds
    the shards' splitters only. Rows equal in text and id can't be told apart and stay together; null ids are an id of
    their own; texts of any length count whole; columns already named size, shard or slot are replaced; an empty table
    gives an empty result.
    """
    added = ["size", "shard", "slot"]
    docs = docs.drop(*added)
    keyed = _keyed(docs, id_col, text_col)
    keys = cut(keyed.select("_k0", "_k1", "_size"))
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("b")).first()["b"]
    share = total / shards
    splitters = find_splitters(keys, [(total * i / shards, share * tolerance) for i in range(1, shards)])
    bits = max(0, (-(-total // PART_BYTES) - 1).bit_length())

    def placed(rows):
        """rows with _shard and _p0, the first bits of the text's hash."""
        a, b = (F.col(c).bitwiseXOR(F.lit(_MIN)) for c in ("_k0", "_k1"))  # as signed numbers in the same order
        past = [(a > F.lit(x + _MIN)) | (a == F.lit(x + _MIN)) & (b >= F.lit(y + _MIN)) for x, y, *_ in splitters]
        shard = sum((c.cast("int") for c in past), F.lit(0))
        return rows.withColumns({"_shard": shard, "_p0": F.shiftrightunsigned("_k0", 64 - bits) if bits else F.lit(0).cast("long")})

    heavy = placed(keys).groupBy("_shard", "_p0").agg(F.sum("_size").alias("b")).where(F.col("b") > 2 * PART_BYTES)
    deep = cut(heavy.select("_shard", "_p0", F.ceil(F.log2(F.col("b") / PART_BYTES)).cast("int").alias("_deep")))
    if deep.count() <= BROADCAST_HEAVY:
        deep = F.broadcast(deep)

    def parted(rows):
        """placed, and _p1: the first bits of the id's hash where the text's have too many bytes."""
        found = placed(rows).join(deep, ["_shard", "_p0"], "left")
        return found.withColumn("_p1", F.when(F.col("_deep").isNull(), F.lit(0)).otherwise(F.expr("shiftrightunsigned(_k1, 64 - _deep)"))).drop("_deep")

    part = ["_shard", "_p0", "_p1"]
    before = Window.partitionBy("_shard").orderBy("_p0", "_p1").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    first = parted(keys).groupBy(*part).agg(F.count("*").alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("_k0", "_k1"))
    return (
        parted(keyed)
        .repartition(min(TASKS, max(shards, -(-total // PART_BYTES))), *part)
        .withColumn("_rank", rank)
        .join(cut(first), part)
        .select("_row.*", F.col("_size").alias("size"), F.col("_shard").alias("shard"), (F.col("_base") + F.col("_rank") - 1).alias("slot"))
    )


def op2_histogram_shards(spark, sf_dir: str) -> DataFrame:
    placed = histogram_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
