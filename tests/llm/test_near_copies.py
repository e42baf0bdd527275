import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))
import brute

import corpus_pipeline
from karakuri.llm import near_copies


def sets(rows):
    found = {}
    for i, text in rows:
        words = (text or "").lower().split()
        k = min(5, len(words))
        found[i, text] = {tuple(words[n : n + k]) for n in range(len(words) - k + 1)} if words else set()
    return list(found.values())


def test_no_near_copies_are_left(spark):
    rows = [(r[0], r[1]) for r in brute.rows_of()]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    docs = spark.createDataFrame(brute.rows_of(), brute.SCHEMA)
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    left = sets((r["doc_id"], r["text"]) for r in kept.collect())
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert not any(a and b and similar(a, b) for k, a in enumerate(left) for b in left[:k])
    # whatever is gone has a copy, by its shingles or by its fingerprint
    gone = [a for a in sets(rows) if a and a not in left]
    assert gone and all(any(b is not a and b and len(a & b) >= 0.5 * len(a | b) for b in sets(rows) if b != a) or Counter(map(frozenset, sets(rows)))[frozenset(a)] > 1 for a in gone)


def test_members_of_a_bucket_are_all_compared(spark):
    """Chains of copies under a common start: many documents in the same buckets, few of them similar."""
    base = [f"w{k}" for k in range(60)]
    rows = [(100 * g + k, " ".join(base + [f"g{g}x{n}" for n in range(60)] + [f"k{k}"])) for g in range(25) for k in range(3)]
    nodes = spark.createDataFrame(rows, "node long, text string")
    gone = {r["node"] for r in near_copies.copies(nodes).collect()}
    assert gone == {i for i, _ in rows if i % 100}
