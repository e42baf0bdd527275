import random
from collections import Counter, defaultdict

import pytest

from karakuri.llm import decontaminate as d

regex = pytest.importorskip("regex")

ITEM = "Alice buys 12 apples for 3 dollars each and gives 5 of them to Bob, how much did Alice pay for the 12 apples?"
SAME = "Carol buys 31 apples for 7 dollars each and gives 9 of them to Dave, how much did Carol pay for the 31 apples?"
LONGER = "Mary Ann buys thirty five apples for 7 dollars each and gives nine of them to Priya, how much did Mary Ann pay for the thirty five apples?"
TORN = "Carol buys 31 apples for 7 dollars each and gives 9 of them to Dave, how much did Eve pay for the 44 apples?"
SHORT, SYMBOLS, TINY = "What is the capital of France?", "Compute 12 + 7 * 3 - 8 / 4 + 19", "Why not?"


def canonical(text):
    """For each form (a: without names, b: with): tokens and where they begin; and the words in lower case."""
    words = [w for w in regex.split(d.BETWEEN, text or "") if w]
    low = [w.lower() for w in words]
    number = [bool(regex.match(r"^[0-9]+(?:[.,:/-][0-9]+)*$", w)) or w in d.NUMBERS.split() for w in low]
    a = ["<num>" if n else "<unit>" if w in d.UNITS.split() and i and number[i - 1] else w for i, (w, n) in enumerate(zip(low, number))]
    b = ["<name>" if x == w and words[i] != w and w not in d.COMMON.split() else x for i, (x, w) in enumerate(zip(a, low))]
    out = {}
    for f, x in (("a", a), ("b", b)):
        begin = [i for i in range(len(x)) if not (x[i] in ("<num>", "<name>") and i and x[i - 1] == x[i])]
        out[f] = [x[i] for i in begin], [*begin, len(x)]
    return out, low


def windows(text, widths=()):
    """(key, i, at, slots) of a text."""
    forms, low = canonical(text)
    for f, (tokens, begin) in forms.items():
        for i in range(len(tokens) - 7):
            slots = [" ".join(low[begin[j] : begin[j + 1]]) if tokens[j][0] == "<" else None for j in range(i, i + 8)]
            yield (8, *tokens[i : i + 8]), i, begin[i], slots
    for n in widths:
        for i in range(len(low) - n + 1) if n else [0]:
            yield (-n, *(low[i : i + n] if n else low)), i, i, None


def brute(docs, items, coverage=d.COVERAGE, run=d.RUN):
    known = {}
    for key in dict.fromkeys((i, t) for i, t in items if t is not None):
        own = {(k, i, at, tuple(s)) for k, i, at, s in windows(key[1]) if sum(x is None for x in s) >= d.PLAIN}
        if not own:
            low = canonical(key[1])[1]
            n = 0 if len(low) < d.LEAST_WORDS else min(len(low), d.WINDOW)
            own = {(k, i, at, s) for k, i, at, s in windows(key[1], (n,)) if k[0] == -n} if low else set()
        known[key] = own
    widths = {-k[0] for own in known.values() for k, *_ in own if k[0] <= 0}
    out = {}
    for doc in dict.fromkeys(docs):
        mine = defaultdict(list)
        for k, i, at, s in windows(doc[1], widths):
            mine[k].append((i, s))
        for item, own in known.items():
            of, places = len({at for _, _, at, _ in own}), defaultdict(list)
            for k, i, at, s in own:
                for j, t in mine.get(k, ()):
                    place = (j - i) // d.SPAN
                    for p in (place - 1, place):
                        places[p].append((at, s, t))
            best = (0, False)
            for hits in places.values():
                pairs = Counter((x, y) for _, s, t in hits if s and t for x, y in zip(s, t) if x is not None and y is not None)
                bad = set()
                for side in (0, 1):
                    for v in {p[side] for p in pairs}:
                        ranked = sorted((p for p in pairs if p[side] == v), key=lambda p: (-pairs[p], p))
                        bad |= set(ranked[1:])
                good = [(at, s, t) for at, s, t in hits if not (s and t and any((x, y) in bad for x, y in zip(s, t)))]
                differs = any(x != y for _, s, t in good if s and t for x, y in zip(s, t))
                best = max(best, (len({at for at, *_ in good}), differs))
            if best[0] and (best[0] / of >= coverage or best[0] > run - d.WINDOW):
                out[doc[0], item[0], best[0], of, best[1]] = out.get((doc[0], item[0], best[0], of, best[1]), 0) + 1
    return Counter(out)


def found(docs, bench, **options):
    return Counter((r["doc"]["id"], r["item"]["id"], r["n_windows"], r["of"], r["reworded"]) for r in d.contaminated(docs, bench, **options).collect())


def test_reworded_items_are_found_and_inconsistent_slots_count_less(spark):
    rows = [(1, f"Before it. {ITEM} After it."), (2, f"x y z {SAME} the end"), (3, "nothing of the kind is here, only some words in a row"), (4, None), (5, ""), (6, TORN), (None, SAME), (2, f"x y z {SAME} the end"), (8, f"So: {LONGER}"), (9, ITEM.upper())]
    items = [(7, ITEM), (8, None), (9, "too short"), (9, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found_ = {r["doc"]["id"]: r for r in d.contaminated(docs, bench, coverage=0.0).collect()}
    assert set(found_) == {1, 2, 6, 8, 9, None}
    assert all(found_[i]["coverage"] == 1 for i in (1, 2, 8, 9, None))
    assert not found_[1]["reworded"] and not found_[9]["reworded"] and found_[2]["reworded"] and found_[None]["reworded"] and found_[8]["reworded"]
    assert found_[6]["coverage"] < 1
    assert found(docs, bench, coverage=0.0) == brute(rows, items, coverage=0.0)


def test_short_and_symbolic_items_and_unknown_names(spark):
    items = [(1, SHORT), (2, SYMBOLS), (3, TINY), (4, "Carol has 4 apples and Dave has 9 pears, who has more?"), (5, "?!")]
    rows = [(1, f"They ask: what is the capital of France"), (2, f"{SYMBOLS} = ?"), (3, "why not"), (4, "why not go there then"), (5, "Priya has 4 apples and Rahul has 9 pears, who has more?"), (6, "What is the capital of Spain?"), (7, "Compute 12 + 7 * 3"), (8, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = found(docs, bench)
    assert {x[:2] for x in got} == {(1, 1), (2, 2), (3, 3), (5, 4)}
    assert got == brute(rows, items)


def test_equals_brute_force(spark):
    r = random.Random(12)
    words = "the red apple costs more than pears but Priya Rahul Ann bought 3 5 12 twenty kg km of them in all why".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, say(r.choice((2, 5, 8, 11, 20, 30))) + r.choice(".?")) for k in range(25)]
    rows = []
    for k in range(60):
        text = r.choice(items)[1]
        if r.random() < 0.6:
            text = " ".join(r.choice(["9", "Zoe", "Li Wei", "forty two"]) if w in ("3", "Priya", "12") and r.random() < 0.7 else w for w in text.split())
        rows.append((k if k % 7 else None, f"{say(r.randrange(0, 30))} {text} {say(r.randrange(0, 30))}" if k % 5 else say(60)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got, want = found(docs, bench), brute(rows, items)
    assert len(want) > 30 and got == want


def test_stage_judges_rows_by_their_own_text(spark, tmp_path):
    spark.createDataFrame([(7, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, ITEM, "a"), (1, "a clean text of the same id", "b"), (None, SAME, "c"), (None, "a clean text without an id", "d"), (None, None, "e"), (2, "", "f"), (2, "", "f"), (3, "word " * 30000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string")
    kept = d.decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(x["item"] for x in kept.collect()) == ["b", "d", "e", "f", "f", "g"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(none, bench).count() == 0
    assert d.contaminated(none, spark.createDataFrame([(7, ITEM), (8, SHORT)], "item_id long, text string")).count() == 0
