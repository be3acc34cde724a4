"""Removed words against a plain count of windows, by both ways of telling anchors."""

import collections
import hashlib
import re

import numpy as np
import pytest

from lodestream.llm import windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    where = collections.defaultdict(list)
    split = [WORD.findall(t or "") for _, t in rows]
    for r, w in enumerate(split):
        for i in range(len(w) - window + 1):
            where[tuple(w[i : i + window])].append((r, i))
    gone = [set() for _ in rows]
    for places in where.values():
        for r, i in places if len(places) > 1 else ():
            gone[r] |= set(range(i, i + window))
    return [(d, len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for (d, _), w, g in zip(rows, split, gone, strict=True)]


def texts(window):
    rng = np.random.default_rng(11)
    say = lambda n, kinds=4000: " ".join(f"w{x}" for x in rng.integers(0, kinds, n))
    passage, line = say(window), say(window - 1)
    base = say(20 * window)
    edited = base.split()
    edited[9 * window] = "changed"
    out = [
        None, "", " \n", "one", passage, say(7) + " " + passage, passage + "\t" + say(11), say(5) + "\n" + passage + " " + say(3), line, say(3) + " " + line, line + " x",
        base, base, " ".join(edited), " ".join(base.split()[3 * window : 6 * window]), "same " * 3 * window, say(4) + " same" * (window + 1), "zwölf\x0bmänner " * window, say(5000),
        say(300, 2), say(300, 2), passage.upper(), "  ".join(passage.split()), say(200) + " " + passage + " " + passage + " " + line,
    ]
    return [(i, t) for i, t in enumerate(out)] + [(3, "one"), (None, passage)]


@pytest.mark.parametrize(("window", "period"), [(35, 21), (8, 7), (8, 3), (35, 31)])
@pytest.mark.parametrize("most", [windows.MOST_PAIRS, 0])
def test_words_left_are_those_of_a_plain_count(spark, window, period, most):
    rows = texts(window)
    docs = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], "doc_id long, text string, kept string, row string").repartition(4)
    got = windows.remove_windows(docs, window=window, period=period, most=most)
    assert got.columns == ["doc_id", "row", "n_words", "n_removed", "kept_sha256", "kept"]
    found = got.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=key) == sorted(plain(rows, window), key=key)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in found)


def test_nothing_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a " * 50)], "doc_id long, text string")
    assert windows.remove_windows(docs.limit(0)).count() == 0
    assert [r.n_removed for r in windows.remove_windows(docs, keep_text=False).collect()] == [50]
