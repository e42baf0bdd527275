import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings
from hypothesis import strategies as st

from karakuri.llm import html_text, packing, pii, ppm, simhash

quick = settings(max_examples=150, deadline=None)


@quick
@given(st.lists(st.integers(1, 4096), max_size=80))
def test_every_item_is_packed_once_without_overlap(lengths):
    lengths = sorted(lengths, reverse=True)
    at, offset, final = packing.best_fit(lengths)
    ends: dict[int, int] = {}
    for n, b, o in sorted(zip(lengths, at, offset), key=lambda x: (x[1], x[2])):
        assert o == ends.get(b, 0)
        ends[b] = o + n
    assert len(ends) == len(final) and all(e <= final[b] for b, e in ends.items())


@quick
@given(st.text(alphabet="abAB1.@-+ %_é5()\n", max_size=80))
def test_base_spans_are_the_patterns(text):
    found = pii.base_spans(text)
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    assert [(s[0], s[2]) for s in found if s[1] == "email"] == email
    assert [(s[0], s[2]) for s in found if s[1] == "phone"] == phone


@quick
@given(st.text(alphabet="<>/abpdivclas=\"' &;!-\n", max_size=200))
def test_any_markup_is_read(html):
    text = html_text.main_text(html, html_text.fit_tree())
    assert text == " ".join(text.split())


@quick
@given(st.text(alphabet="abC é\t\n", max_size=60))
def test_fingerprint_is_the_majority(text):
    (_, want, _), = brute.simhash_components([(1, text)])
    assert simhash.fingerprint_of(text.encode()).hex() == want


@quick
@given(st.lists(st.text(alphabet="abc dé", max_size=20), min_size=1, max_size=6))
def test_trie_scores_are_those_of_the_definition(texts):
    import numpy as np

    rows = list(enumerate(texts))
    trains = [k % 2 == 0 for k in range(len(rows))]
    plain = [b" ".join(ppm.canonical(t.encode())) for t in texts]
    keys, counts = ppm.count_block([p for p, t in zip(plain, trains) if t])
    nodes = []
    for k in range(ppm.ORDER + 1):
        own, at = np.unique(keys >> np.uint64(8 * (ppm.ORDER - k)), return_inverse=True)
        nodes.append((own, np.bincount(at, counts).astype(np.int64)))
    assert np.allclose(ppm.Trie(nodes).scores(plain), brute.ppm_scores(rows, trains), atol=1e-3)
