import random
import re

import numpy as np
import pyarrow as pa

from bandweave.llm import words as W


def test_words_equal_a_split(monkeypatch):
    monkeypatch.setattr(W, "STEP", 60)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\n\t\r\x0b\x0c日x ") for _ in range(rng.randrange(80))) for _ in range(200)] + [None, "", " "]
    seen = {}
    for t in W.texts(pa.array(texts)):
        h = W.hashed(t.data, t.starts, t.ends)
        for i in range(len(t)):
            want = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", texts[t.first + i] or "")]
            got = [t.data[a:b].tobytes() for a, b in zip(t.starts[t.words[i] : t.words[i + 1]], t.ends[t.words[i] : t.words[i + 1]])]
            assert got == want
            for w, x in zip(want, h[t.words[i] : t.words[i + 1]]):
                assert seen.setdefault(w, x) == x
    assert len(set(map(int, seen.values()))) == len(seen)


def test_hashes_do_not_depend_on_place_or_span(monkeypatch):
    text = "alpha beta " + "x" * 3000 + " gamma alpha " + "x" * 3000 + " beta"
    one = next(W.texts(pa.array([text])))
    whole = W.hashed(one.data, one.starts, one.ends)
    assert whole[0] == whole[4] and whole[1] == whole[6] and whole[2] == whole[5]
    monkeypatch.setattr(W, "SPAN", 1000)
    short = W.hashed(one.data, one.starts, one.ends)
    assert short[2] == short[5] and np.array_equal(short[[0, 1, 3]], whole[[0, 1, 3]])


def test_slices_and_large_strings():
    column = pa.array(["zero", "one two", None, "three"]).slice(1, 3)
    for c in (column, column.cast(pa.large_string())):
        t = next(W.texts(c))
        assert list(np.diff(t.words)) == [2, 0, 1]
