"""Difference covers, common extensions and periodic runs against plain loops."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodestream.llm import covers, periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("period", sorted(covers.COVERS))
def test_any_two_residues_reach_the_cover_by_one_shift(period):
    table, inside = covers.shifts(period), covers.sampled(period)
    for i in range(period):
        for j in range(period):
            t = next(t for t in range(period) if inside[(i + t) % period] and inside[(j + t) % period])
            assert table[i, j] == t


def extension(s, i, j):
    n = 0
    while max(i, j) + n < len(s) and s[i + n] == s[j + n]:
        n += 1
    return n


def plain_runs(s, least=6, times=4):
    out = {}
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            n = extension(s, i, i + q)
            if n + q >= max(least, times * q):
                out.setdefault((i, n + q), q)
            i += n + 1
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


#: Words of few kinds, with stretches repeated up to 12 times.
PIECES = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=6).map(lambda x: [w for piece, n in x for w in piece * n])


@given(st.lists(PIECES, max_size=5), st.sampled_from([3, 7, 13]))
@settings(max_examples=150, deadline=None)
def test_runs_are_those_of_a_plain_loop(sequences, period):
    assert periods.find_runs([np.array(x, np.int64) for x in sequences], period=period) == [plain_runs(x) for x in sequences]
    assert periods.find_runs([np.array(x, np.int64) for x in sequences], 2, 2, period) == [plain_runs(x, 2, 2) for x in sequences]


@given(PIECES.filter(lambda x: len(x) > 1), st.sampled_from([3, 7, 13, 21]), st.data())
@settings(max_examples=100, deadline=None)
def test_extensions(s, period, data):
    ask = periods.Extensions(np.array(s, np.int64), period)
    pairs = data.draw(st.lists(st.tuples(st.integers(0, len(s) - 1), st.integers(0, len(s) - 1)).filter(lambda x: x[0] != x[1]), min_size=1, max_size=20))
    i, j = np.array(pairs, np.int64).T
    assert ask(i, j).tolist() == [extension(s, a, b) for a, b in pairs]


def test_few_questions_at_a_time_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    sequences = [np.concatenate([rng.integers(0, 50, 300), np.tile(rng.integers(0, 50, k), 6)]) for k in (1, 7, 40)]
    whole = periods.find_runs(sequences)
    monkeypatch.setattr(periods, "MOST_ASKED", 10)
    assert periods.find_runs(sequences) == whole == [plain_runs(x.tolist()) for x in sequences]


TEXTS = [
    None, "", " \n", "one", "a a a a a", "a a a a a a", "a a " * 7, "x " * 30 + "y", "one two three " * 5 + "end", "a b a b a b a b a b b b b b b b",
    "line of words\n" * 40 + "tail\x0b" + "zwölf\x0cmänner " * 9, "w " * 4000, " ".join(map(str, range(3000))), " ".join(f"{i % 700} x" for i in range(3500)),
]


def test_texts_keep_one_period_of_each_run(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([*rows, rows[8], (None, "b b b b b b", "clash", 1)], "doc_id long, text string, runs string, row int").repartition(3)
    got = periods.periodic_runs(docs)
    assert got.columns == ["doc_id", "row", "n_words", "runs", "collapsed"]
    found = got.collect()
    assert len(found) == len(TEXTS) + 2
    for r in found:
        w = WORD.findall((TEXTS[r.doc_id] if r.doc_id is not None else "b b b b b b") or "")
        runs = plain_runs(w)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert (r.n_words, [(x.start, x.length, x.period) for x in r.runs]) == (len(w), runs)
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_query_is_that_of_a_plain_loop(spark, sf_dir, tmp_path):
    folder = str(tmp_path)
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = [t if i < 14 else real[i - 14] for i, t in enumerate([*TEXTS, *real])]
    ids = [i * 7 for i in range(len(texts))]
    # some of the ids that the rule picks
    picked = [i for i in range(2000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(texts)]
    rows = [*zip(ids, texts, strict=True), *zip(picked, texts, strict=False)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{folder}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periods(spark, f"file://{folder}").collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        w, h = WORD.findall(t or ""), zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w) if n < 3500 or len(set(w)) > 1 else [(0, n, 1)]
        gone = {i for a, m, q in runs for i in range(a + q, a + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == expected, d
