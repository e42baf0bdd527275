"""Substring dedup by fixed-block anchors: repeated passages go from every document but the first that has them.

Documents are cut into blocks of neighbouring ids. Each block's documents index their non-overlapping anchors of
ANCHOR words and probe with every rolling window of that length. Two exchanges of hashes tell a block, a bit for each
hash it sent, which of its probes hit an anchor of an earlier document (or its anchors a probe of a later one), and
which of the windows of WINDOW words around such hits begin in an earlier document. Runs of these are the maximal repeats.
"""

from __future__ import annotations

from contextlib import contextmanager
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.llm.common import cut, shuffles_freed, table

#: Words in a repeat at least; every run of so many words holds a whole anchor of the document it is compared with.
WINDOW = 13
ANCHOR = (WINDOW + 1) // 2
#: Text in one block, and the least number of blocks; a block is what one Python worker holds at a time.
BLOCK_BYTES, LEAST_BLOCKS = 12 << 20, 48
#: Ranges of ids whose bytes are counted, for each block; blocks are put together from them.
FINE = 4
_P, _Q, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


class _Hashes(dict):
    """Word to hash; forgets its words when there are too many."""

    def __missing__(self, word):
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_C)
    return x ^ (x >> np.uint64(32))


class _Block:
    """The documents of one block in order of id: rank (equal ids share one), and where each one's words begin."""

    def __init__(self, rows):
        import numpy as np

        known = _Hashes()
        rows = sorted(((i, t or b"") for i, t in rows if i is not None))
        self.texts = [t for _, t in rows]
        self.ids = [i for i, _ in rows]
        hashes, starts = [], [0]
        for text in self.texts:
            words = text.split()
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
            starts.append(starts[-1] + len(words))
        w = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.starts = np.array(starts, np.int64)
        lengths = np.diff(self.starts)
        ranks = np.cumsum([0, *(a != b for a, b in zip(self.ids, self.ids[1:]))])[: len(self.ids)]
        self.rank = np.repeat(ranks, lengths).astype(np.int32)
        left = np.repeat(self.starts[1:], lengths) - np.arange(len(w))  # words from here to the document's end
        n = max(0, len(w) - ANCHOR + 1)
        h = w[:n].copy()
        for j in range(1, ANCHOR):
            h = h * np.uint64(_P) + w[j : n + j]
        self.h = _mixed(h)
        self.whole = left[:n] >= ANCHOR
        self.anchor = self.whole & ((np.arange(n) - np.repeat(self.starts[:-1], lengths)[:n]) % ANCHOR == 0)
        self.window = left >= WINDOW

    def probes(self):
        """Distinct hashes of the rolling windows in order; of each its least rank as an anchor (a high one: none), and
        its highest rank; and the number of each position's hash."""
        import numpy as np

        at = np.nonzero(self.whole)[0]
        keys, number = np.unique(self.h[at], return_inverse=True)
        first, last = np.full(len(keys), 1 << 30, np.int32), np.full(len(keys), -1, np.int32)
        rank = self.rank[at]
        np.maximum.at(last, number, rank)
        fixed = self.anchor[at]
        np.minimum.at(first, number[fixed], rank[fixed])
        return at, keys, number, first, last

    def windows(self, earlier, later):
        """Windows of WINDOW words around hits: positions, distinct (key, check), each one's first rank, numbers.

        earlier, later: for each distinct probe, whether an earlier block has it as an anchor, and whether it is an
        anchor here and a later block has it."""
        import numpy as np

        at, keys, number, first, last = self.probes()
        rank, fixed = self.rank[at], self.anchor[at]
        hit = earlier[number] | (first[number] < rank) | (fixed & (later[number] | (last[number] > rank)))
        hits = np.zeros(len(self.h) + 1, np.int64)
        hits[at + 1] = hit
        hits = np.cumsum(hits)
        s = np.nonzero(self.window)[0]
        s = s[hits[s + ANCHOR] > hits[s]]
        a, b = self.h[s], self.h[s + ANCHOR - 1]  # the two halves overlap in one word
        keys, index, number = np.unique(_mixed(a * np.uint64(_P) + b), return_index=True, return_inverse=True)
        check = (_mixed(b * np.uint64(_Q) ^ a) >> np.uint64(32)).astype(np.uint32)[index]
        first = np.full(len(keys), 1 << 30, np.int32)
        np.minimum.at(first, number, self.rank[s])
        return s, keys, check, first, number


def _parts(keys, bits: int):
    """Where each bucket of sorted keys (their top bits) begins, and the end."""
    import numpy as np

    return np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _answers(pieces, block: int, kind: str, buckets: int, lengths):
    """The flags that came back for one kind of question, in the order in which the keys were sent."""
    import numpy as np

    got = {r["bucket"]: r for r in pieces if r["kind"] == kind}
    out = []
    for name in ("a", "b"):
        bits = [np.unpackbits(np.frombuffer(got[k][name], np.uint8), count=n).astype(bool) if n else np.zeros(0, bool) for k, n in enumerate(lengths)]
        out.append(np.concatenate(bits) if bits else np.zeros(0, bool))
    return out


def _rows(data):
    import pyarrow as pa

    return zip(data.column("id").to_pylist(), data.column("text").cast(pa.binary()).to_pylist())


ASKED = "bucket int, block int, kind string, keys binary, checks binary, flags binary"
ANSWER = "block int, kind string, bucket int, a binary, b binary"


def _table(rows, schema: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))]
    return pa.Table.from_pylist(rows, schema=pa.schema(fields))


def _answer(data):
    """One bucket: for each block's keys, whether an earlier block flagged the key, and whether the block flagged it
    and a later one has it."""
    import numpy as np

    rows = sorted(data.to_pylist(), key=lambda r: r["block"])
    keys, flags, blocks, checks = [], [], [], []
    for r in rows:
        raw = np.frombuffer(r["keys"], np.uint8).reshape(-1, len(r["keys"]) // max(1, len(r["flags"])) or 8)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, : raw.shape[1]] = raw
        keys.append(wide.view("<u8").ravel())
        flags.append(np.frombuffer(r["flags"], np.uint8))
        checks.append(np.frombuffer(r["checks"], np.uint32) if r["checks"] else np.zeros(len(raw), np.uint32))
        blocks.append(np.full(len(raw), r["block"], np.int32))
    k, f, c, b = (np.concatenate(x) for x in (keys, flags, checks, blocks))
    order = np.lexsort((c, k)) if c.any() else np.argsort(k, kind="stable")
    ks, cs, bs, fs = k[order], c[order], b[order], f[order].astype(bool)
    new = np.ones(len(ks), bool)
    new[1:] = (ks[1:] != ks[:-1]) | (cs[1:] != cs[:-1])
    starts, run = np.nonzero(new)[0], np.cumsum(new) - 1
    low = np.minimum.reduceat(np.where(fs, bs, 1 << 30), starts)
    high = np.maximum.reduceat(bs, starts)
    a, z = np.zeros(len(k), bool), np.zeros(len(k), bool)
    a[order], z[order] = low[run] < bs, fs & (high[run] > bs)
    ends = np.cumsum([len(x) for x in keys])
    out = [{"block": r["block"], "kind": r["kind"], "bucket": r["bucket"], "a": np.packbits(a[e - len(x) : e]).tobytes(), "b": np.packbits(z[e - len(x) : e]).tobytes()} for r, x, e in zip(rows, keys, ends)]
    return _table(out, ANSWER)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): each document's words without repeats, joined by one space.

    A word goes if it lies in a run of WINDOW words that also begins in a document with a smaller id. Words are maximal
    runs without white space; null and empty texts have none. Rows with equal ids are one document that does not repeat
    itself, yet each gives a row; rows with a null id are kept whole and nothing is compared with them. Runs are compared by
    96 bits of hash on top of their place among the buckets. Ids are whole numbers; others are an error. Texts of any
    length are read whole, other columns are ignored. An empty table gives an empty result. Hashes travel packed, a row
    for each block and bucket that has any, so there are never more rows than hashes.
    """
    import numpy as np
    from pyspark.sql.types import IntegralType

    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of whole numbers, whose order says which document is the first")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    bits = max(6, (blocks - 1).bit_length())
    cells = FINE * blocks
    marks = rows.agg(F.percentile_approx("id", [i / cells for i in range(1, cells)], min(20 * cells, 2_000_000)).alias("m")).first()["m"] or []
    marks = spark.sparkContext.broadcast(np.array(sorted(set(marks)), np.int64))

    def cell_of(ids):
        import pandas as pd

        return pd.Series(np.searchsorted(marks.value, ids.to_numpy().astype(np.int64), "left").astype(np.int32))

    sizes = rows.where("id IS NOT NULL").select(F.pandas_udf(cell_of, "int")("id").alias("c"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("b"))
    number = np.zeros(len(marks.value) + 1, np.int64)
    for r in sizes.groupBy("c").agg(F.sum("b").alias("b")).collect():  # a row for each cell
        number[r["c"]] = r["b"]
    # A block takes neighbouring cells until it has its share of the bytes.
    block_of_cell = spark.sparkContext.broadcast(np.minimum(np.cumsum(number) - number, max(0, total - 1)) * blocks // max(1, total))

    def block_of(ids):
        import pandas as pd

        null = ids.isna().to_numpy()
        found = block_of_cell.value[np.searchsorted(marks.value, ids.fillna(0).to_numpy().astype(np.int64), "left")]
        return pd.Series(np.where(null, np.arange(len(ids)) % blocks, found).astype(np.int32))

    placed = rows.withColumn("block", F.pandas_udf(block_of, "int")("id"))

    def ask_probes(data):
        import numpy as np

        block = _Block(_rows(data))
        _, keys, _, first, _ = block.probes()
        ends, fixed = _parts(keys, bits), (first < 1 << 30).astype(np.uint8)
        low = ((keys << np.uint64(bits)) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        number = data.column("block")[0].as_py()
        return _table([{"bucket": k, "block": number, "kind": "probe", "keys": low[s:e].tobytes(), "checks": b"", "flags": fixed[s:e].tobytes()} for k, (s, e) in enumerate(zip(ends, ends[1:])) if e > s], ASKED)

    def found_windows(data, answers):
        block = _Block(_rows(data))
        keys = block.probes()[1]
        ends = _parts(keys, bits)
        return block, block.windows(*_answers(answers, 0, "probe", 1 << bits, ends[1:] - ends[:-1]))

    def ask_windows(data, answers):
        import numpy as np

        if not data.num_rows:
            return _table([], ASKED)
        _, (_, keys, check, _, _) = found_windows(data, answers.to_pylist())
        ends, number = _parts(keys, bits), data.column("block")[0].as_py()
        return _table([{"bucket": k, "block": number, "kind": "window", "keys": keys[s:e].astype("<u8").tobytes(), "checks": check[s:e].tobytes(), "flags": np.ones(e - s, np.uint8).tobytes()} for k, (s, e) in enumerate(zip(ends, ends[1:])) if e > s], ASKED)

    def strip(data, answers):
        import numpy as np
        import pyarrow as pa

        out = [(None, len(t.split()), 0, b" ".join(t.split())) for i, t in ((i, t or b"") for i, t in _rows(data)) if i is None]
        if data.num_rows:
            pieces = answers.to_pylist()
            block, (at, keys, _, first, number) = found_windows(data, pieces)
            ends = _parts(keys, bits)
            earlier, _ = _answers(pieces, 0, "window", 1 << bits, ends[1:] - ends[:-1])
            gone = at[earlier[number] | (first[number] < block.rank[at])]
            edge = np.zeros(len(block.rank) + WINDOW + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + WINDOW, -1)
            covered = np.cumsum(edge)[: len(block.rank)] > 0
            for i, text, s, e in zip(block.ids, block.texts, block.starts, block.starts[1:]):
                words, drop = text.split(), covered[s:e]
                n = int(drop.sum())
                out.append((i, len(words), n, b" ".join([w for w, d in zip(words, drop.tolist()) if not d] if n else words)))
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        columns[3] = columns[3].cast(pa.string())
        return pa.table(columns, names=["id", "n_words", "n_removed", "kept"])

    by_block = placed.groupBy("block")
    with shuffles_freed(spark):
        told = cut(by_block.applyInArrow(ask_probes, ASKED).groupBy("bucket").applyInArrow(_answer, ANSWER))
        asked = by_block.cogroup(told.groupBy("block")).applyInArrow(ask_windows, ASKED)
        told = told.unionByName(cut(asked.groupBy("bucket").applyInArrow(_answer, ANSWER)))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(strip, "id bigint, n_words bigint, n_removed bigint, kept string")


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
