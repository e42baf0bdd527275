"""Language-model scoring by prediction by partial matching over bytes, with a pretrained context trie.

The trie is never in one place. Texts are dealt into blocks; each block asks for the distinct windows and words that it
has, packed by part of the key space. A part adds up what all blocks count, scores its windows and answers each block;
its windows are all those after the same three bytes, so it has every longer context itself. Only nodes of up to
LOW_ORDER bytes of context are known to all parts, and there are 256 ** (LOW_ORDER + 1) of these at most.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karakuri.llm.common import cut, removed, shuffles_freed, table, written

#: Bytes of context at most, and those of the nodes that every part is given.
ORDER, LOW_ORDER = 5, 2
#: Text in one block, and the least number of blocks; a block is what one Python worker holds at a time.
BLOCK_BYTES, LEAST_BLOCKS = 20 << 20, 48
#: The end of a text; also stands for what is before its start. It is never part of UTF-8.
END = 0xFF
_CHUNK, _MERGE, _PIECE = 1 << 21, 1 << 21, 1 << 16


def canonical(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z in lower case. The model sees them joined by one space, and then END."""
    return (text or b"").lower().split()


def _windows(texts):
    """8-byte windows that end at each byte of each text and its END, the last byte highest; and where texts begin."""
    import numpy as np

    pad = bytes([END]) * 7
    raw = b"".join([pad + t + bytes([END]) for t in texts])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(starts[-1]) + 7 * np.repeat(np.arange(len(texts)), lengths)
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw, 0, (1,)), at, starts


def _slices(texts):
    """The texts in lists of about _CHUNK bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pieces(keys):
    """For each run of _PIECE windows (48 bits each): distinct ones, their counts, and the number of each position's."""
    import numpy as np

    place = np.arange(_PIECE, dtype=np.uint64)
    for at in range(0, len(keys), _PIECE):
        own = keys[at : at + _PIECE]
        both = own << np.uint64(16) | place[: len(own)]  # a plain sort of numbers is faster than one of their places
        both.sort()
        k = both >> np.uint64(16)
        new = np.concatenate(([True], k[1:] != k[:-1]))
        first = np.nonzero(new)[0]
        number = np.empty(len(own), np.uint16)
        number[(both & np.uint64(0xFFFF)).astype(np.int64)] = (np.cumsum(new) - 1).astype(np.uint16)
        yield k[first], np.diff(first, append=len(own)), number


def _added(parts) -> tuple:
    """Sorted distinct keys of [(keys, counts)] and the sums of their counts."""
    import numpy as np

    keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)])
    keys, number = np.unique(keys, return_inverse=True)
    counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
    return keys, np.bincount(number, counts, len(keys)).astype(np.int64)


class _Counts:
    """Adds up counts of keys, and keeps what it holds small."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys, counts):
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > _MERGE + len(self.parts[0][0]):
            self.parts = [self.all()]
            self.size = len(self.parts[0][0])

    def all(self):
        return _added(self.parts)


def count_block(texts) -> tuple:
    """The distinct (ORDER + 1)-byte windows of canonical texts, and their counts."""
    import numpy as np

    counts = _Counts()
    for wide, at, _ in map(_windows, _slices(texts)):
        for keys, n, _ in _pieces(wide[at] >> np.uint64(8 * (7 - ORDER))):
            counts.add(keys, n)
    return counts.all()


def trie_nodes(keys, counts, low=()) -> list:
    """Distinct windows and their counts -> sorted keys and counts of the nodes of every order; low: those of the
    lowest orders, if they are known from elsewhere. Windows that were never counted have no node."""
    import numpy as np

    keys, counts = keys[counts > 0], counts[counts > 0]
    nodes = [*low]
    for k in range(len(low), ORDER + 1):
        own, number = np.unique(keys >> np.uint64(8 * (ORDER - k)), return_inverse=True)
        nodes.append((own, np.bincount(number, counts, len(own)).astype(np.int64)))
    return nodes


class Trie:
    """Log10 probabilities of a pretrained context trie (escape method C, with exclusion), for whole arrays of bytes.

    In a context c with counts that sum to T over D symbols, a seen symbol has count / (T + D) and the escape D / (T + D).
    After an escape the shorter context leaves out the symbols of the longer one. As a longer context's symbols are
    all known to the shorter, what is left out follows from the longer context alone, and is kept with it.
    """

    def __init__(self, nodes):
        """nodes: for each order k the sorted keys (k bytes of context, oldest lowest, then the symbol) and their counts."""
        import numpy as np

        log = lambda x: np.log10(np.maximum(x, 1e-300))
        self.keys = [np.asarray(k, np.uint64) for k, _ in nodes]
        self.count = [log(c) for _, c in nodes]
        self.contexts, self.total, self.escape, self.low, self.low_escape = [], [], [], [], []
        sums = []
        for k, (_, counts) in enumerate(nodes):
            keys = self.keys[k]
            contexts, number = np.unique(keys & np.uint64((1 << 8 * k) - 1), return_inverse=True)
            t, d = np.bincount(number, counts, len(contexts)), np.bincount(number, minlength=len(contexts))
            sums.append((t, d))
            self.contexts.append(contexts)
            self.total.append(log(t + d))
            self.escape.append(log(d) - log(t + d))
            if k == 0:
                self.low.append(log(np.maximum(256 - d, 1)))
                self.low_escape.append(np.zeros(len(d)))
                continue
            shorter = np.searchsorted(self.keys[k - 1], keys >> np.uint64(8))
            left_out = np.bincount(number, np.asarray(nodes[k - 1][1], float)[shorter], len(contexts))
            up = np.searchsorted(self.contexts[k - 1], contexts >> np.uint64(8))
            t2, d2 = sums[k - 1][0][up] - left_out, sums[k - 1][1][up] - d
            self.low.append(log(t2 + d2))
            self.low_escape.append(np.where(t2 + d2 > 0, log(d2) - log(t2 + d2), 0))

    def _find(self, table, keys):
        import numpy as np

        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def log10(self, wide):
        """The log10 probability of the last byte of each 8-byte window after the bytes before it."""
        import numpy as np

        out = np.zeros(len(wide))
        node, seen = self._find(self.keys[ORDER], wide >> np.uint64(8 * (7 - ORDER)))
        context = np.searchsorted(self.contexts[ORDER], self.keys[ORDER][node[seen]] & np.uint64((1 << 8 * ORDER) - 1))
        out[seen] = self.count[ORDER][node[seen]] - self.total[ORDER][context]
        if not seen.all():
            out[~seen] = self._escaped(wide[~seen])
        return out

    def _escaped(self, wide):
        """The same for symbols that the longest context doesn't have."""
        import numpy as np

        n = len(wide)
        score, done = np.zeros(n), np.zeros(n, bool)
        longer, above = np.zeros(n, bool), np.zeros(n, np.int64)  # whether the longer context is known, and which it is
        for k in range(ORDER, -1, -1):
            key = wide >> np.uint64(8 * (7 - k))
            context, known = self._find(self.contexts[k], key & np.uint64((1 << 8 * k) - 1))
            seen = np.zeros(n, bool)
            some = k < ORDER and len(self.low[k + 1])
            low, low_escape = (self.low[k + 1][above], self.low_escape[k + 1][above]) if some else (0, 0)
            if k < ORDER:
                node, seen = self._find(self.keys[k], key)
                seen &= ~done
            if seen.any():
                whole = np.where(longer, low, self.total[k][context] if len(self.total[k]) else 0)
                score[seen] += (self.count[k][node] - whole)[seen]
            done |= seen
            go = ~done & known
            if go.any():
                score[go] += np.where(longer, low_escape, self.escape[k][context])[go]
            longer, above = known, context
        left = ~done
        if left.any():  # every byte that no context has is equally likely
            score[left] -= np.where(longer, self.low[0][above] if len(self.low[0]) else 0, np.log10(256))[left]
        return score

    def scores(self, texts):
        """The log10 probability of each canonical text and its END."""
        import numpy as np

        out = [np.zeros(0)]
        for part in _slices(texts):
            wide, at, starts = _windows(part)
            out.append(np.add.reduceat(self.log10(wide[at]), starts[:-1]))
        return np.concatenate(out)


def _packed(a) -> bytes:
    """An array as compressed bytes, its first bytes first, then its second ones."""
    import numpy as np

    return zlib.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes(), 1)


def _unpacked(raw: bytes, kind):
    import numpy as np

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _hashed(words):
    """The words' hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _dealt(keys, kind: str, parts: int):
    """Of sorted keys: their order by part, and where each part begins. Windows go by the three bytes before the last."""
    import numpy as np

    h = (keys >> np.uint64(16) & np.uint64(0xFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33) if kind == "g" else keys
    part = (h % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


ASKED = "kind string, part int, block int, n bigint, keys binary, counts binary"
TOLD = "kind string, part int, block int, n bigint, answers binary"


def _arrow(rows, schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = pa.schema([pa.field(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])
    return pa.RecordBatch.from_pylist(rows, schema=fields)


def _learner(parts: int):
    """What a block asks: a row for each part of its windows (g) and words (w) with their counts in training texts; its
    training texts (d); and its counts of the nodes of LOW_ORDER (t), each a row."""

    def learn(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        grams, words, other, texts, block = _Counts(), Counter(), set(), 0, None
        for batch in batches:
            rows = zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("train").to_pylist())
            block = batch.column("block")[0].as_py() if batch.num_rows else block
            held = {True: [], False: []}
            for text, train in rows:
                tokens = canonical(text)
                (words if train else other).update(tokens)
                held[train].append(b" ".join(tokens))
                texts += train
            for train, own in held.items():
                for wide, at, _ in map(_windows, _slices(own)):
                    for keys, n, _ in _pieces(wide[at] >> np.uint64(8 * (7 - ORDER))):
                        grams.add(keys, n if train else np.zeros(len(n), np.int64))
        if block is None:
            return
        known = [*words, *other.difference(words)]
        hashes = _hashed(known)
        by_hash = np.argsort(hashes)
        number = np.concatenate((np.fromiter(words.values(), np.int64, len(words)), np.zeros(len(known) - len(words), np.int64)))
        del words, other, known
        for kind, (keys, counts) in (("w", (hashes[by_hash], number[by_hash])), ("g", grams.all())):
            order, ends = _dealt(keys, kind, parts)
            for p, (s, e) in enumerate(zip(ends, ends[1:])):
                if e > s:
                    own = keys[order[s:e]]
                    yield _arrow([{"kind": kind, "part": p, "block": block, "n": e - s, "keys": _packed(np.diff(own, prepend=np.uint64(0))), "counts": _packed(counts[order[s:e]])}], ASKED)
            if kind == "g":
                low, at = np.unique(keys >> np.uint64(8 * (ORDER - LOW_ORDER)), return_inverse=True)
                n = np.bincount(at, counts, len(low)).astype(np.int64)
                rows = [{"kind": "t", "part": k, "block": block, "n": c} for k, c in zip(low.tolist(), n.tolist()) if c]
                yield _arrow([*rows, {"kind": "d", "part": 0, "block": block, "n": texts}], ASKED)

    return learn


def _solver(low):
    """What a part answers: to each block, for its keys in order, the windows' log10 probabilities or the words' counts."""

    def solve(batches):
        import numpy as np

        asked = [r for b in batches for r in b.to_pylist()]
        for kind in "wg":
            own = [r for r in asked if r["kind"] == kind]
            counts = _Counts()
            for r in own:
                counts.add(np.cumsum(_unpacked(r["keys"], np.uint64)), _unpacked(r["counts"], np.int64))
            keys, n = counts.all()
            if kind == "g":
                found = Trie(trie_nodes(keys, n, low.value)).log10(keys << np.uint64(8 * (7 - ORDER))).astype(np.float32)
            else:
                found = n
                yield _arrow([{"kind": "v", "part": 0, "block": -1, "n": int((n > 0).sum())}, {"kind": "n", "part": 0, "block": -1, "n": int(n.sum())}], TOLD)
            for r in own:
                at = np.searchsorted(keys, np.cumsum(_unpacked(r["keys"], np.uint64)))
                yield _arrow([{"kind": kind, "part": r["part"], "block": r["block"], "n": r["n"], "answers": _packed(found[at])}], TOLD)

    return solve


def score_documents(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    train: an SQL condition on docs; the documents that meet it are learnt from, every window of every one. Tokens are
    the words in lower case (A-Z), and one end; they are told apart by 64 bits of hash. base_score adds up log10 of the
    smoothed share of each token among the training tokens; score is the trie's log10 probability of the words joined
    by one space, and the end. A null text counts as empty, rows with null or repeated ids are each scored, texts of any
    length are read whole, without training documents every byte is equally likely; other columns are ignored; an empty
    table gives an empty result.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b")).first()["b"]
    blocks = parts = max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))
    placed = docs.select(
        F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"),
    )

    with shuffles_freed(spark):
        asked, asked_at = written(placed.repartitionById(blocks, "block").mapInArrow(_learner(parts), ASKED), "ppm")
        sums = asked.where("kind = 't'").groupBy("part").agg(F.sum("n").alias("n")).toArrow()  # 256 ** 3 rows at most
        low = spark.sparkContext.broadcast(_low_nodes(sums))
        told, told_at = written(asked.where("kind IN ('g', 'w')").repartitionById(parts, "part").mapInArrow(_solver(low), TOLD), "ppm")
        texts = asked.where("kind = 'd'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        removed(spark, asked_at)
        n = {r["kind"]: r["n"] for r in told.where("kind IN ('v', 'n')").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    n_all, distinct = n.get("n", 0) + texts, n.get("v", 0) + (texts > 0)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [to_arrow_type(docs.schema[id_col].dataType), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]

    def score(batches):
        import numpy as np

        answers, rows, held, words, chunks = {}, [], [], set(), []
        for batch in batches:
            own = batch.filter(batch.column("kind").is_valid())
            for k, p, raw in zip(*(own.column(c).to_pylist() for c in ("kind", "part", "answers"))):
                answers[k, p] = raw
            own = batch.filter(batch.column("kind").is_null())
            held += own.column("train").to_pylist()
            rows.append(own.column("id"))
            texts_ = []
            for text in own.column("text").cast(pa.binary()).to_pylist():
                tokens = canonical(text)
                words.update(tokens)
                texts_.append(b" ".join(tokens))
            chunks += [(part, None) for part in _slices(texts_)]
        if not held:
            return
        counts = _Counts()
        for c, (part, _) in enumerate(chunks):
            wide, at, starts = _windows(part)
            found = list(_pieces(wide[at] >> np.uint64(8 * (7 - ORDER))))
            for keys, n_, _ in found:
                counts.add(keys, n_)
            chunks[c] = (part, ([(keys, number) for keys, _, number in found], starts))

        def answered(keys, of, dtype):
            order, ends = _dealt(keys, of, parts)
            out = np.zeros(len(keys), dtype)
            for p, (s, e) in enumerate(zip(ends, ends[1:])):
                if e > s:
                    out[order[s:e]] = _unpacked(answers[of, p], dtype)
            return out

        keys = counts.all()[0]
        value = answered(keys, "g", np.float32)
        known = list(words)
        hashes = _hashed(known)
        by_hash = np.argsort(hashes)
        c = np.empty(len(known), np.int64)
        c[by_hash] = answered(hashes[by_hash], "w", np.int64)
        number_of, scale = dict(zip(known, c.tolist())), np.log10(n_all + distinct + 1)
        end, out = np.log10(texts + 1), []
        for part, (found, starts) in chunks:
            log = np.concatenate([value[np.searchsorted(keys, k)][number] for k, number in found]).astype(np.float64)
            for text, s in zip(part, np.add.reduceat(log, starts[:-1]).tolist()):
                tokens = text.split(b" ") if text else []
                n_ = np.fromiter(map(number_of.__getitem__, tokens), np.int64, len(tokens))
                out.append((len(tokens) + 1, int((n_ > 0).sum()) + (texts > 0), n_all, float(np.log10(n_ + 1).sum() + end - scale * (len(tokens) + 1)), s))
        ids = pa.concat_arrays(rows).cast(types[0])
        columns = [ids, [not x for x in held], *zip(*out)]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(columns[1:], types[1:]))], names=names)

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    every = placed.unionByName(told.where("kind IN ('g', 'w')").select("block", "kind", "part", "answers"), allowMissingColumns=True)
    with shuffles_freed(spark):
        out = cut(every.repartitionById(blocks, "block").mapInArrow(score, schema))
    removed(spark, told_at)
    return out


def _low_nodes(sums) -> list:
    """Sums of the nodes of LOW_ORDER -> the nodes of that and every lower order."""
    import numpy as np

    keys, counts = (sums.column(c).to_numpy() for c in ("part", "n"))
    out = []
    for k in range(LOW_ORDER + 1):
        own, number = np.unique(keys.astype(np.uint64) >> np.uint64(8 * (LOW_ORDER - k)), return_inverse=True)
        out.append((own, np.bincount(number, counts, len(own)).astype(np.int64)))
    return out


def op5_ppm(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), "crc32(coalesce(cast(doc_id AS string), '')) % 7 <> 2")
