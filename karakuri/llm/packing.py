"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.llm.common import table

#: Permitted sequence lengths in tokens.
CAPACITIES = (512, 1024, 2048, 4096)
#: Documents are packed in groups of about this many tokens, dealt out by a hash of their id and text. A group that gets
#: more, as many rows equal in both make it, is packed in stretches of HELD times as many.
GROUP_TOKENS, HELD = 2_000_000, 4
#: Tasks at most; a task packs its groups one after another.
TASKS = 20_000


def sequence_cost(capacity: int) -> float:
    """What one sequence costs: its tokens, plus attention that grows with the square of its length."""
    return capacity + capacity * capacity / 16384


def best_fit(lengths: list[int], capacities=CAPACITIES, cost=sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """Pack lengths, given in decreasing order: (bin of each item, offset of each item, capacity of each bin).

    An item goes to the open bin that it fills best. Where none holds it, a bin opens at the least-cost capacity that
    holds it among those of a floor and above. The packing is tried with every permitted capacity as the floor; at the
    end each bin is cut down to the smallest capacity for its contents, and the floor of least total cost is kept.
    """
    sizes = sorted(capacities)
    best = None
    for floor in sizes:
        opened = [min((c for c in sizes if c >= max(floor, n)), key=lambda c: (cost(c), c)) for n in range(sizes[-1] + 1)]
        used: list[int] = []
        free_bins: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
        free, at, offset = 0, [], []  # free: bit r is set if some open bin has r tokens left
        for n in lengths:
            fits = free >> n
            if fits:
                left = n + (fits & -fits).bit_length() - 1
                b = free_bins[left].pop()
                if not free_bins[left]:
                    free ^= 1 << left
            else:
                left, b = opened[n], len(used)
                used.append(0)
            at.append(b)
            offset.append(used[b])
            used[b] += n
            if left > n:
                free_bins[left - n].append(b)
                free |= 1 << (left - n)
        final = [next(c for c in sizes if c >= u) for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, at, offset, final)
    return best[1:]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities=CAPACITIES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(id_col, piece, start, length, bin, capacity, offset): where each piece of each document's tokens goes.

    Tokens are the words and one end token, so an empty or null text has one. A document longer than the largest
    capacity is cut into pieces of that many tokens and a rest; no token is dropped. bin numbers are unique and depend
    on the rows alone, not on their order or partitions: items go by length, id, text (its hash) and piece. Rows with a
    null id are packed like others, repeated rows once each, texts of any length are read whole, an empty table gives an
    empty result, other columns are ignored. No task holds more than one stretch of one group.
    """
    most = max(capacities)
    n = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1
    sized = docs.select(F.col(id_col), n.cast("long").alias("n"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-total // group_tokens))
    pieces = (
        sized.select(id_col, "n", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("piece"))
        .select(id_col, "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).alias("length"), F.pmod(F.xxhash64(id_col, "h", "piece"), F.lit(groups)).alias("bin"), "h")
        .repartition(min(groups, TASKS), "bin")
        .sortWithinPartitions("bin", F.desc("length"), id_col, "h", "piece")
        .drop("h")
    )
    names = [id_col, "piece", "start", "length", "bin", "capacity", "offset"]

    def run(batches):
        import pyarrow as pa

        def packed(rows, first):
            whole = pa.Table.from_batches(rows)
            at, offset, final = best_fit(whole.column(3).to_pylist(), capacities)
            group = whole.column(4)[0].as_py()
            more = [[(group << 32) + first + b for b in at], [final[b] for b in at], offset]
            return len(final), pa.table([*whole.columns[:4], *(pa.array(x, pa.int64()) for x in more)], names=names).to_batches()

        held, size, now, bins = [], 0, None, 0  # rows of one group and their tokens; the group, and its bins so far
        for batch in batches:
            column, lengths, start, tokens = batch.column(4).to_pylist(), batch.column(3).to_pylist(), 0, 0
            for k in range(1, len(column) + 1):
                tokens += lengths[k - 1]
                if k < len(column) and column[k] == column[start] and (size if column[start] == now else 0) + tokens < HELD * group_tokens:
                    continue
                if column[start] != now:
                    if held:
                        yield from packed(held, bins)[1]
                    held, size, now, bins = [], 0, column[start], 0
                held.append(batch.slice(start, k - start))
                size, start, tokens = size + tokens, k, 0
                if size >= HELD * group_tokens:
                    opened, out = packed(held, bins)
                    yield from out
                    held, size, bins = [], 0, bins + opened
        if held:
            yield from packed(held, bins)[1]

    schema = pieces.select(id_col, "piece", "start", "length", "bin", F.lit(0).cast("long").alias("capacity"), F.lit(0).cast("long").alias("offset")).schema
    return pieces.mapInArrow(run, schema)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences to train on: one row for each piece of each document, with its bin, the bin's length and its place.

    Null texts and null ids are packed like others (see pack_documents); an empty table gives an empty result."""
    return pack_documents(docs)
