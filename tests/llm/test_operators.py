import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute

from karakuri.llm import html_text, licenses, packing, pii, ppm, quality, repeats, sharding, simhash
from karakuri.llm.components import star_components


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(brute.rows_of(), brute.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in brute.rows_of()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def bag(rows):
    return Counter(map(str, rows))


# 1 quality rules

def test_quality_base_and_columns(spark, docs, pairs):
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in pairs[::2] if i] + [(None, 1, 0), (4, 0, None)], "doc_id long, quality int, toxic int")
    weights = quality.ratio_weights(docs, labels)
    scored = quality.quality_scores(docs, weights)
    got = bag((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in scored.collect())
    assert got == bag((i, *brute.quality_base(t)) for i, t in pairs)
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD) for r in scored.collect())


def test_quality_ratio_equals_brute_force(spark, docs, pairs):
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    rows = docs.select("doc_id", "text")
    good = {i for i, _ in pairs[::3] if i is not None}
    labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    grams = rows.select("doc_id", F.transform(quality.words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).withColumn("g", F.concat("h", F.transform(F.slice("h", 1, F.greatest(F.size("h") - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("h", i + 1)))))
    held = [(r["doc_id"], [x % quality.BUCKETS for x in r["g"]]) for r in grams.collect()]
    word = brute.WORD.findall(pairs[0][1])[0]
    assert grams.where(F.col("doc_id") == pairs[0][0]).first()["h"][0] == signed(xxhash.xxh64_intdigest(word.encode(), 42))
    raw, target = Counter(), Counter()
    for i, g in held:
        raw.update(g)
        if i in good:
            target.update(g)
    share = sum(target.values()) / sum(raw.values())
    want = Counter((i, round(sum(math.log((target[b] + quality.SMOOTHING) / (raw[b] * share + quality.SMOOTHING)) for b in g) / max(1, len(g)), 3)) for i, g in held)
    got = Counter((r["doc_id"], round(r["llr"], 3)) for r in quality.quality_scores(rows, quality.ratio_weights(rows, labels)).collect())
    assert sum((want - got).values()) <= 2  # a rounding at the last digit


def test_quality_without_labels_or_documents(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["llr"] for r in quality.quality_scores(docs, quality.ratio_weights(docs, labels)).collect()} == {0.0}
    assert quality.quality_scores(none, quality.ratio_weights(none, labels)).count() == 0


def test_quality_stage_keeps_rows_as_they_are(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = quality.quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() > 0 and kept.where("kept <> 'mine'").count() == 0


# 2 sharding

def test_shards_are_whole_even_and_gapless(spark):
    r = random.Random(1)
    rows = [(k, "hot text " * 20 if k % 3 == 0 else "w" * r.randrange(0, 400)) for k in range(3000)] + [(None, None), (7, "")]
    placed = sharding.histogram_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bag((x["doc_id"], x["text"]) for x in placed) == bag(rows)
    size, slots, largest = defaultdict(int), defaultdict(list), 0
    for x in placed:
        assert x["size"] == len((x["text"] or "").encode()) + 1
        size[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        largest = max(largest, x["size"])
    mean = sum(size.values()) / 16
    assert sorted(size) == list(range(16)) and all(abs(s - mean) <= largest + mean * 2 * sharding.GROUP_TOLERANCES * sharding.TOLERANCE for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for x in placed:
        where[x["text"]].add(x["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 15


def test_shards_in_several_parts(spark, docs, pairs, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 500)
    placed = sharding.histogram_shards(docs, shards=3)
    assert placed.columns == ["doc_id", "text", "kept", "block", "size", "shard", "slot"]
    slots = defaultdict(list)
    for x in placed.collect():
        slots[x["shard"]].append(x["slot"])
    assert sum(map(len, slots.values())) == len(pairs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_large_group_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BYTES", 2000)
    rows = [(k, "the same text in a third of all rows" if k % 3 else f"text {k}") for k in range(1500)]
    placed = sharding.histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=4)
    slots = defaultdict(list)
    for x in placed.collect():
        slots[x["shard"]].append(x["slot"])
    assert sum(map(len, slots.values())) == 1500 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_shards_of_an_empty_table(none):
    assert sharding.histogram_shards(none).count() == 0


# 3 HTML

PAGE = """<!DOCTYPE html><html><head><title>Site</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header><div>My site</div></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Blog</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies to give you the best experience, and so on and so on.</div>
<article><h1>A title &amp; more</h1><p>First <b>bold</b>   paragraph&nbsp;with a <a href="x">link</a> and
many words that go on for quite some time.</p><div class="advert">Buy cheap things now, all for free today only</div><p>Last.</article>
<section id="comments"><p>A reader says that all this is quite wrong, and says so at length.</p></section>
<form><label>Your name</label><input></form><footer>&copy; 2024 <a href="/t">Terms</a></footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE, html_text.fit_tree()) == "A title & more First bold paragraph with a link and many words that go on for quite some time. Last."


def test_elements_left_open_do_not_swallow_the_page():
    tree, said = html_text.fit_tree(), "A paragraph with a good many words in it that goes on for quite some time and then ends."
    body = f"<article><p>{said}</p></article>"
    assert html_text.main_text(f"<html><head><title>Site</title><meta charset=utf-8><body>{body}</html>", tree) == said
    for name in ("button", "video", "option", "canvas", "noscript"):
        assert html_text.main_text(f"<body><{name}>{body}</body>", tree) == said
        assert html_text.main_text(f"<body><{name}>{body}<{name}>no</{name}></body>", tree) == said
        assert html_text.main_text(f"<body>{body}<article><{name}><p>{said}</p><{name}>x</{name}></{name}></article></body>", tree) == said
    assert html_text.main_text(f"<body>{body}<script>{body}", tree) == said


def test_one_class_word_does_not_delete_an_article():
    tree, said = html_text.fit_tree(), "A paragraph with a good many words in it that goes on for quite some time and then ends."
    for name in ("legal-search article", "sidebar content", "post social"):
        assert html_text.main_text(f'<body><div class="{name}"><p>{said}</p><p>{said}</p></div></body>', tree) == f"{said} {said}"
    assert html_text.main_text(f'<article><p>{said}</p></article><div class="comment">{said}</div><footer>{said}</footer>', tree) == said
    assert html_text.main_text(f"<article><p>{said}</p><a href=x><div>A link around a block</div></a></article>", tree) == said
    assert html_text.main_text(f"<article><p><a href=x>An open link <p>{said}</article>", tree) == said


def test_features_are_those_of_blocks_and_neighbours():
    r = random.Random(3)
    page, want = [], []
    for _ in range(60):
        n, linked = r.randrange(1, 40), r.choice((0, 0, 1, 3))
        linked = min(n, linked)
        named, article, heading = r.random() < 0.2, r.random() < 0.4, r.random() < 0.2
        text = " ".join(["<a href='#'>" + " ".join(["link"] * linked) + "</a>"] * (linked > 0) + ["word"] * (n - linked))
        text = f"<h2>{text}</h2>" if heading else f"<p>{text}</p>"
        text = f"<div class='sidebar'>{text}</div>" if named else text
        page.append(f"<main>{text}</main>" if article else text)
        want.append((n, linked / n, int(named), int(article), int(heading)))
    got = html_text.blocks("".join(page))
    assert len(got) == len(want)
    for k, (_, f) in enumerate(got):
        before, after = want[k - 1][:2] if k else (0, 0.0), want[k + 1][:2] if k + 1 < len(want) else (0, 0.0)
        assert dict(zip(html_text.FEATURES, f)) == dict(zip(html_text.FEATURES, (*want[k][:2], *before, *after, *want[k][2:])))


def test_broken_markup_is_read_once():
    import time

    tree = html_text.fit_tree()
    for piece in ("<a ", "<![CDATA[", "<a \"> \"", "<a '\">", "<p <b>", "<a \"<b'\" ", "<!-- ", "<button>", "<"):
        began = time.time()
        html_text.main_text(piece * (1_000_000 // len(piece)), tree)
        assert time.time() - began < 10, piece
    assert html_text.main_text("<p>plain < text & 1 <2 and a<b or c " + "more " * 20, tree) == "plain < text & 1 <2 and a<b or c " + "more " * 19 + "more"


def test_tree_fits_its_table():
    tree = html_text.fit_tree()

    def used(t):
        return {html_text.FEATURES[t[0]]} | used(t[2]) | used(t[3]) if isinstance(t, tuple) else set()

    wrong = [r for r in html_text.LABELLED if html_text.is_main(tree, r) != bool(r[-1])]
    assert len(wrong) <= 2 and len(html_text.LABELLED) < 200
    assert used(tree) >= {"words", "links", "words_before", "links_after", "words_after"}


def test_pages(spark):
    rows = [(1, "u", PAGE, "mine"), (2, "v", None, "mine"), (None, None, "", None), (3, "w", "<article><p>" + "a word or two here " * 20000, "x"), (1, "u", PAGE, "mine"), (4, "z", "plain < text & more", "y")]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = [r["text"] for r in got]
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert texts[0] == texts[4] != "" and texts[1] == texts[2] == "" and len(texts[3]) == 20000 * 19 - 1


# 4 packing

def test_best_fit_is_whole_and_downsized():
    r = random.Random(2)
    lengths = sorted((r.randrange(1, 4097) if r.random() < 0.2 else r.randrange(1, 300) for _ in range(1500)), reverse=True)
    at, offset, final = packing.best_fit(lengths)
    used = defaultdict(list)
    for n, b, o in zip(lengths, at, offset):
        used[b].append((o, n))
    for b, placed in used.items():
        placed.sort()
        assert placed[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(placed, placed[1:]))
        total = sum(n for _, n in placed)
        assert final[b] == min(c for c in packing.CAPACITIES if c >= total)
    assert sum(lengths) / sum(final) > 0.97
    assert packing.best_fit([]) == ([], [], [])


def test_best_fit_no_worse_than_one_size():
    r = random.Random(4)
    lengths = sorted((r.randrange(1, 700) for _ in range(400)), reverse=True)
    cost = lambda sizes: sum(map(packing.sequence_cost, packing.best_fit(lengths, sizes)[2]))
    assert cost(packing.CAPACITIES) <= min(cost((c,)) for c in packing.CAPACITIES if c >= lengths[0])


def test_packed_documents(docs, pairs, none):
    rows = packing.pack_documents(docs, capacities=(64, 256), group_tokens=800).collect()
    total = defaultdict(int)
    for x in rows:
        total[x["doc_id"]] += x["length"]
    want = defaultdict(int)
    for i, t in pairs:
        want[i] += len(brute.WORD.findall(t or "")) + 1
    assert total == want
    bins = defaultdict(list)
    for x in rows:
        bins[x["bin"]].append(x)
    assert all(sum(x["length"] for x in b) <= b[0]["capacity"] for b in bins.values())
    again = packing.pack_documents(docs.repartition(2), capacities=(64, 256), group_tokens=800).collect()
    assert bag(rows) == bag(again)
    assert packing.pack_documents(none).count() == 0


def test_groups_of_rows_without_an_id_or_all_alike(spark):
    rows = [(None, f"text number {k} " + "w " * (k % 50)) for k in range(600)] + [(7, "one and the same row")] * 900
    packed = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacities=(64, 128), group_tokens=300).collect()
    assert sum(x["length"] for x in packed) == sum(len(t.split()) + 1 for _, t in rows)
    bins = defaultdict(list)
    for x in packed:
        bins[x["bin"]].append(x)
    assert len({b >> 32 for b in bins}) > 20  # not all in the group of one id
    for b in bins.values():
        placed = sorted((x["offset"], x["length"]) for x in b)
        assert placed[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(placed, placed[1:])) and sum(n for _, n in placed) <= b[0]["capacity"]
        assert len({x["capacity"] for x in b}) == 1


# 5 language model

def test_scores_equal_brute_force(docs, pairs, none):
    condition = "crc32(coalesce(cast(doc_id AS string), '')) % 7 <> 2"
    got = ppm.score_documents(docs, condition).collect()
    trains = [not brute.held_out(i) for i, _ in pairs]
    words = [brute.WORD.findall(brute.lowered(t)) for _, t in pairs]
    count = Counter(w for x, train in zip(words, trains) if train for w in x)
    n, v = sum(count.values()) + sum(trains), len(count) + 1
    scale = math.log10(n + v + 1)
    want = Counter()
    for (i, _), x, train, s in zip(pairs, words, trains, brute.ppm_scores(pairs, trains)):
        base = sum(math.log10(count[w] + 1) - scale for w in x) + math.log10(sum(trains) + 1) - scale
        want[i, not train, len(x) + 1, sum(count[w] > 0 for w in x) + 1, n, round(base, 2), round(s, 1)] += 1
    have = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 2), round(r["score"], 1)) for r in got)
    assert sum((want - have).values()) <= 2  # a rounding at the last digit
    assert ppm.score_documents(none, condition).count() == 0


def test_scores_without_training(spark):
    got = ppm.score_documents(spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string"), "false").collect()
    assert {r["doc_id"]: round(r["score"], 6) for r in got} == {1: round(-3 * math.log10(256), 6), 2: round(-math.log10(256), 6)}


def test_no_node_is_left_out():
    import numpy as np

    n = 1_200_000  # windows with so many contexts that there are over 3,000,000 nodes
    grams = np.unique((np.arange(n, dtype=np.uint64) * np.uint64(2654435761) % np.uint64(1 << 40)) * np.uint64(256) + np.uint64(97))
    nodes = ppm.trie_nodes(grams, np.ones(len(grams), np.int64))
    assert len(grams) == n and sum(len(keys) for keys, _ in nodes) > 3_000_000
    assert len(nodes[ppm.ORDER][0]) == n and all(counts.sum() == n for _, counts in nodes)


def test_parts_know_all_that_their_windows_need(spark, docs, pairs, monkeypatch):
    """As many blocks and parts as there are, the scores are the same."""
    scores = []
    for least in (1, 7):
        monkeypatch.setattr(ppm, "LEAST_BLOCKS", least)
        rows = ppm.score_documents(docs, "doc_id % 2 = 1").collect()
        scores.append(bag((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in rows))
    assert scores[0] == scores[1] and sum(scores[0].values()) == len(pairs)


def test_pruned_trie_still_sums_to_one():
    import numpy as np

    text = b"the theory of the thing then thaws"
    keys, counts = ppm.count_block([text] * 3)
    nodes = []
    for k in range(ppm.ORDER + 1):
        own, at = np.unique(keys >> np.uint64(8 * (ppm.ORDER - k)), return_inverse=True)
        n = np.bincount(at, counts)
        nodes.append((own[n >= 6], n[n >= 6].astype(np.int64)))
    trie = ppm.Trie(nodes)
    for context in (b"the the", b"xxxxthe", b"\xff" * 7, b"qqqqqqq"):
        wide = np.array([int.from_bytes(context + bytes([s]), "little") for s in range(256)], np.uint64)
        assert abs((10.0 ** trie.log10(wide).astype(float)).sum() - 1) < 1e-4


# 6 licences

def test_licenses(spark, docs, none):
    apache = dict(licenses.TEMPLATES)["Apache-2.0"]
    rows = [(1, f"words before it. Licensed under the Apache License, Version 2.0. And words after it"), (2, "ALL RIGHTS RESERVED"), (3, "all rights are mine"), (4, "x " * 3000 + "Released under the MIT License. " + apache), (5, None), (None, "All rights reserved."), (2, "ALL RIGHTS RESERVED")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(1, "Apache-2.0"), (2, "Proprietary"), (4, "MIT"), (4, "Apache-2.0"), (None, "Proprietary")}
    assert licenses.scan_licenses(none).count() == 0 and licenses.scan_licenses(docs).count() == 0


# 7 near-duplicates

def test_near_duplicates_equal_brute_force(docs, pairs, none):
    got = simhash.near_duplicates(docs)
    assert bag((r["id"], f"{r['fp'] % (1 << 64):016x}", r["component"]) for r in got.collect()) == bag(brute.simhash_components(pairs))
    assert simhash.near_duplicates(none).count() == 0


def test_long_posting_lists_link_alike():
    r = random.Random(6)
    start = r.getrandbits(64)
    members = {start}
    while len(members) < 700:
        members.add(r.choice(list(members)) ^ (1 << r.randrange(16)) if r.random() < 0.7 else start ^ r.getrandbits(16))
    signed = [m - (1 << 64) if m >> 63 else m for m in members]

    def roots(edges):
        parent = {m: m for m in signed}
        for a, b in edges:
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        return {m: find(m) for m in signed}

    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2]
    groups = lambda found: Counter(Counter(found.values()).values())
    assert groups(roots(simhash._link(signed))) == groups(roots(near)) == groups(roots(simhash._link(signed[:300]) + [e for e in near]))


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (200, 200), (500, 300), (400, 300)]
    got = {r["node"]: r["root"] for r in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(2, 61)}, 101: 100, 400: 300, 500: 300}


def test_near_duplicate_stage(spark, docs, pairs):
    kept = simhash.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    found = brute.simhash_components(pairs)
    roots = {c for i, _, c in found if i is not None}
    alone = sum(c is None for *_, c in found)  # a text without an id stays unless a row with an id has it too
    assert sorted(i for i in ids if i is not None) == sorted(roots) and ids.count(None) == alone == 1


def test_near_duplicate_stage_judges_rows_not_ids(spark):
    one, two = "a text of id three that is long enough to have some shingles", "another text of the same id as a copy"
    rows = [(3, one), (5, one), (5, two), (None, one), (None, "nobody else says this at all"), (5, two)]
    kept = simhash.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert bag(map(tuple, kept)) == bag([(3, one), (5, two), (None, "nobody else says this at all")])


def test_long_lists_are_posted_again(spark, monkeypatch):
    r = random.Random(9)
    start = r.getrandbits(64)
    members = {start ^ (r.getrandbits(24) << r.choice((0, 8, 40))) for _ in range(300)}
    members |= {m ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for m in list(members)[:80]}
    signed = sorted(m - (1 << 64) if m >> 63 else m for m in members)
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2}
    fps = spark.createDataFrame([(m,) for m in signed], "fp long")
    groups = []
    for long_ in (512, 4):
        monkeypatch.setattr(simhash, "LONG", long_)
        found = {(min(e["a"], e["b"]), max(e["a"], e["b"])) for e in simhash.links(fps).collect()}
        groups.append({x["node"]: x["root"] for x in star_components(spark.createDataFrame(sorted(found), "a long, b long")).collect()})
    want = {x["node"]: x["root"] for x in star_components(spark.createDataFrame(sorted(near), "a long, b long")).collect()}
    assert groups[0] == groups[1] == want


# 9 repeats

def test_repeats_equal_brute_force(docs, pairs, none):
    got = repeats.remove_repeats(docs).collect()
    assert bag(map(tuple, got)) == bag(brute.without_repeats(pairs))
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_need_whole_numbers(spark):
    with pytest.raises(TypeError):
        repeats.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


# 10 personal data

def test_base_spans_equal_plain_patterns(pairs):
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    r = random.Random(8)
    for _ in range(500):
        text = "".join(r.choice("aB1.@-+ %_é5") for _ in range(40))
        assert [(m.start(), "email", m.end()) for m in email.finditer(text)] == [s for s in pii.base_spans(text) if s[1] == "email"]
        quad = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert quad == [(s[0], s[2]) for s in pii.base_spans(text) if s[1] == "ip"]
    assert pii.base_spans("4539 1488 0343 6467 or +1 (202) 555-0143 or 256.1.1.1 or 10.0.0.1") == [(0, "card", 19), (23, "phone", 40), (57, "ip", 65)]
    assert pii.base_spans("1" * 5000) == []


def test_field_finds_secrets_and_keeps_labels_alike():
    key = "6df57b16f87eabefefcab67b433efd90636bb6bd"
    _, found = pii.all_spans(f'é token = "{key}" and later {key} with v2.0. in 2021', pii.fitted())
    assert [s[1] for s in found] == ["secret", "secret"] and [s[2] - s[0] for s in found] == [40, 40]
    assert pii.all_spans("In 2021 we sold 12,500 of version 2.0. and 17 more", pii.fitted())[1] == []


def test_secrets_of_letters_are_found_where_they_recur():
    found = pii.all_spans("the password = qwertzuiopHG was sent, and later qwertzuiopHG again; token : the item is here", pii.fitted())[1]
    assert [(s[1], s[2] - s[0]) for s in found] == [("secret", 12)] * 2
    assert pii.all_spans("no password is needed and nothing else is said about it", pii.fitted())[1] == []


def test_card_spans_equal_plain_patterns():
    import re

    r = random.Random(11)
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    for _ in range(400):
        text = " ".join(r.choice(["4539 1488 0343 6467", "x", "12-34", "4539148803436467", "5" * r.randrange(1, 25), "- 7", "0000-0000-0000"]) for _ in range(5))
        digits = [(m.span(), re.sub("[ -]", "", m[0])) for m in card.finditer(text)]
        assert [span for span, d in digits if 12 <= len(d) <= 19 and pii.luhn(d)] == [(s[0], s[2]) for s in pii.base_spans(text) if s[1] == "card"]


def test_messages_equal_exact_inference():
    import itertools

    import numpy as np

    model = pii.fitted()
    names, w, t, u = model[0], *(np.asarray(m) for m in model[1:])
    r = random.Random(4)
    for chain, skip, most in (([(0, 1), (1, 2)], [], 0.02), ([(0, 1)], [(1, 3)], 0.02), ([(0, 1), (1, 2)], [(0, 2), (2, 3)], 0.15)):  # two trees, one loop
        for _ in range(5):
            seen = [r.sample(sorted(names), 4) for _ in range(4)]
            score = np.array([w[[names[f] for f in row]].sum(axis=0) for row in seen])
            exact = np.zeros((4, len(pii.LABELS)))
            for y in itertools.product(range(len(pii.LABELS)), repeat=4):
                p = np.exp(sum(score[i][k] for i, k in enumerate(y)) + sum(t[y[a]][y[b]] for a, b in chain) + sum(u[y[a]][y[b]] for a, b in skip))
                for i, k in enumerate(y):
                    exact[i][k] += p
            exact /= exact.sum(axis=1, keepdims=True)
            assert np.abs(pii.beliefs(seen, chain, skip, model) - exact).max() < most


def test_field_is_right_on_held_out_remarks():
    right = total = 0
    for text, labels in pii.labelled_texts(150, seed=99):
        spans = pii.all_spans(text, pii.fitted())[1]
        for m, label in zip(brute.WORD.finditer(text), labels):
            if not pii.DIGIT.search(m[0]):
                continue
            found = next((s[1] for s in spans if s[0] < m.end() and m.start() < s[2]), "none")
            total += 1
            right += found == label
    assert right / total > 0.95


def test_pii_rows(spark, none):
    rows = [(1, "mail a.b@c.example.com now", "k"), (None, None, None), (2, "", "k"), (1, "mail a.b@c.example.com now", "k")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    assert [[tuple(s) for s in r["base"]] for r in got] == [[(5, "email", 22)], [], [], [(5, "email", 22)]]
    assert pii.find_pii(none).count() == 0
    table = spark.createDataFrame([(1, "mail a.b@c.example.com now", "en", "s", 26), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r) for r in pii.pii_stage(spark, table, "").collect()] == [(1, "mail <EMAIL> now", "en", "s", 16), (2, None, None, None, None)]
