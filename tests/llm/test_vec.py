import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm.vec import Words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é-字.\n_", max_size=20)), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_runs_of_letters_and_digits(texts):
    w = Words(texts)
    expected = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    assert np.diff(w.first).tolist() == [len(e) for e in expected]
    flat = [x for e in expected for x in e]
    seen = dict(zip(flat, w.hash.tolist(), strict=True))
    assert [seen[x] for x in flat] == w.hash.tolist() and len(set(seen.values())) == len(seen)
    g, first = w.grams(2)
    pairs = [(i, tuple(e[j : j + 2])) for i, e in enumerate(expected) for j in range(len(e) - 1)]
    assert [r for r, _ in pairs] == w.row[first].tolist()
    of = {}
    for (_, p), h in zip(pairs, g.tolist(), strict=True):
        assert of.setdefault(p, h) == h
    assert len(set(of.values())) == len(of)


def test_hashes_do_not_depend_on_the_batch():
    alone, among = Words(["Some words here"]), Words(["other", "Some words here", ""])
    assert alone.hash.tolist() == among.hash[among.row == 1].tolist()
