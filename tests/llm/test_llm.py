"""The training-data operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import collections
import gzip
import hashlib
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestream.llm import decontaminate, imatch, minhash, mixing, pii, quality, queries, repeats, tokens, url_filter, warc
from lodestream.session import table

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def texts():
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdeéß"), 5)) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = say(120), say(60)
    near = base.split()
    near[50] = "changed"
    out = [base, base, " ".join(near), say(40) + "\n" + passage + "\n" + say(30), passage.upper(), say(80) + " " + passage, None, "", "  \n", "one", "one", "two words", "Zwölf Boxkämpfer", "achte " * 400, say(3000), "x" * 5000, base + " " + say(3)]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 4 else f"s{i % 3}", "clash", 1) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, n_hit int").repartition(3)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# --- archives


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "ü" * 40_000, "x\r\n\r\nWARC/1.1\r\n" * 9000, "<p>a</p>", "last\r\n"]
    rows = [(i, f"http://h{i}/\nx" if i else None, h) for i, h in enumerate(html)]
    return spark.createDataFrame([*rows, (None, "u", "<p>a</p>"), rows[7]], "page_id long, url string, html string")


@pytest.mark.parametrize("least", [0, 100])
def test_archives_round_trip(spark, pages, tmp_path, least):
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, least=least, segment=10_000, chunk=999)
    got = warc.read_archives(spark, path).collect()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    largest = {}
    for p, b in rows:
        largest[b] = max(largest.get(b, -1), -1 if p is None else p)
    expected = []
    for p, b in rows:
        again = len(b) >= least and p != largest[b]
        expected.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", largest[b] if again else None, b))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    seen = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got]
    assert sorted(seen, key=key) == sorted(expected, key=key) and all(r.complete for r in got)


def test_archives_of_nothing(spark, pages, tmp_path):
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/w")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 0


def test_missing_segment_and_wrong_digest_are_incomplete(spark, tmp_path):
    records = list(warc._records(5, "u", "y" * 50_000, "BAD", None, False, 10_000, 999))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress("".join(r + "\r\n\r\n" for i, r in enumerate(records) if i != 2).encode()))
    whole = list(warc._records(6, "u", "z", "BAD", None, False, 10_000, 999))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole[0].encode() + b"\r\n\r\n"))
    got = {r.page_id: r.complete for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got == {5: False, 6: False}


@given(st.binary(max_size=300), st.integers(1, 50))
@settings(max_examples=50, deadline=None)
def test_chunked_framing(body, size):
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    framed = b"".join(b"%X;ext=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"
    assert warc.dechunk(framed) == body
    if body:
        with pytest.raises(ValueError):
            warc.dechunk(framed[: len(framed) - 6 - min(size, len(parts[-1]))])


# --- decontamination


def leaks(items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t or ""))
        for a in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[a : a + 10])].add(i)
    out = {}
    for d, t in texts():
        w, hit, met = ALNUM.findall(low(t or "")), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    hit |= set(range(a, a + size))
                    met |= {i for i in windows[tuple(w[a : a + size])] if i is not None}
        out[d] = (len(w), len(hit), sorted(met))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_leaks_by_broadcast_and_by_shuffle(spark, docs, limit):
    passage = dict(texts())[4]
    items = [(1, passage), (2, "one"), (3, None), (4, " .,"), (5, passage), (None, "two words"), (11, dict(texts())[0][:200])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(docs, benchmark, limit=limit)
    assert "n_hit" in got.columns and "score" in got.columns
    assert by_id(got, "n_words", "n_hit", "hit_items") == leaks(items)
    clean = by_id(decontaminate.decontaminate(docs, benchmark, limit=limit), "text")
    told = leaks(items)
    assert set(clean) == {d for d, (n, hit, _) in told.items() if not hit or hit < n}
    assert all(len(ALNUM.findall(low(clean[d][0] or ""))) == told[d][0] - told[d][1] for d in clean)
    assert all(clean[d][0] == t for d, t in texts() if d in clean and not told[d][1])


def test_leaks_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {v[1] for v in by_id(decontaminate.find_leaks(docs, none), "n_words", "n_hit").values()} == {0}
    assert decontaminate.find_leaks(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WINDOWS, 0])
def test_leaks_with_clashing_names(spark, limit):
    names = ["row", "said", "id", "hits", "items", "_row", "w"]
    df = spark.createDataFrame([(1, "one two", *names), (1, "one two", *names), (None, None, *names)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    items = spark.createDataFrame([(1, "two", "x"), (2, "two", "x"), (2, "two", "x")], "item_id long, text string, window string")
    got = decontaminate.find_leaks(df, items, limit=limit).collect()
    assert sorted((r.n_hit, tuple(r.hit_items)) for r in got) == [(0, ()), (1, (1, 2)), (1, (1, 2))] and all(r[n] == n for r in got for n in names)
    assert {r.text for r in decontaminate.decontaminate(df, items, limit=limit).collect()} == {"one ", None}


# --- fingerprints


def test_edits_and_equal_texts(spark, docs):
    got = by_id(imatch.compare_with_edits(docs), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next")
    rows = [(d, t or "") for d, t in texts()]
    for i, (d, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[d][:2] == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d][3] <= 1 and (edited != t or got[d][3] == 1) and (after != t or got[d][4] == 1)
    for d, t in rows:
        assert all(got[d][2] == got[e][2] for e, u in rows if u == t)


def test_next_row_of_one_row_ties_and_nulls(spark):
    schema = "doc_id long, text string"
    assert [r.next.text for r in imatch.with_next(spark.createDataFrame([(1, "a")], schema)).collect()] == ["a"]
    rows = [(5, "a"), (5, "a"), (None, "n"), (10**12, "z"), (-3, "m")]
    got = imatch.with_next(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.text, r.next.text) for r in got) == sorted([(5, "a", "a"), (5, "a", "z"), (0, "n", "m"), (10**12, "z", "n"), (-3, "m", "a")])
    assert imatch.with_next(spark.createDataFrame([], schema)).count() == 0


def plain_likeness(kept_a, kept_b):
    """Share of equal subsets among those of which a term occurs, by sets; subsets are drawn by the same hash."""
    draws = [(r, m - 1) for r in range(imatch.REPEATS) for m in imatch.ONE_IN]
    pairs = [({t for t, h in kept_a.items() if h[r] & m == 0}, {t for t, h in kept_b.items() if h[r] & m == 0}) for r, m in draws]
    some = [(a, b) for a, b in pairs if a or b]
    return (sum(a == b for a, b in some) + (set(kept_a) == set(kept_b))) / (len(some) + 1)


@pytest.mark.parametrize("most", [imatch.MOST_TERMS, 3])
def test_fingerprints_by_plain_sets(spark, most):
    rng = np.random.default_rng(12)
    vocabulary = [f"wört{int(x)}" for x in rng.integers(0, 80, 400)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 40))))) for i in range(60)] + [(60, None), (61, ""), (62, "Xyz xyz"), (63, "Xyz, XYZ")]
    rows += [(70, rows[3][1]), (71, rows[3][1].upper())]
    names = ["fingerprint", "row", "said", "_all", "_kept", "t"]
    df = spark.createDataFrame([(*r, *names) for r in rows], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in names)]))
    sets = {d: set(ALNUM.findall(low(t or ""))) for d, t in rows}
    seen = collections.Counter(w for s in sets.values() for w in s)
    band = {w for w, n in seen.items() if max(2, 0.03 * len(rows)) <= n <= max(2, 0.3 * len(rows))}
    assert 10 < len(band) < len(seen)
    got = by_id(imatch.fingerprints(df, known=imatch.lexicon(df, low=0.03, high=0.3, most=most)), "fingerprint", "row")
    own = {d: frozenset(s & band or s) for d, s in sets.items()}
    assert all((got[d][0] == got[e][0]) == (own[d] == own[e]) for d in own for e in own) and got[0][1] == "row"
    drawn = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in seen], "w string").select("w", F.array(*[F.xxhash64(F.xxhash64("w"), F.lit(r)) for r in range(imatch.REPEATS)]).alias("h")).collect()}
    near = by_id(imatch.compare_with_edits(df, low=0.03, high=0.3, most=most), "near_edited", "near_next")
    kept = lambda t: {w: drawn[w] for w in (lambda s: s & band or s)(set(ALNUM.findall(low(t))))}
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        if set(ALNUM.findall(low(edited))) <= set(drawn):  # a cut may make a new word
            assert abs(near[d][0] - plain_likeness(kept(t), kept(edited))) < 1e-9
        assert abs(near[d][1] - plain_likeness(kept(t), kept(after))) < 1e-9
    assert imatch.compare_with_edits(df.limit(0)).count() == 0 and imatch.fingerprints(df.limit(0)).count() == 0


# --- mixing


@given(st.integers(1, 5000), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_permutation_is_one_and_invertible(n, seed):
    x = np.arange(n)
    there = mixing.permute(x, n, "t", seed)
    assert sorted(there.tolist()) == x.tolist()
    assert mixing.permute(there, n, "t", seed, inverse=True).tolist() == x.tolist()


@pytest.mark.parametrize("block", [8, 64])
def test_words_taken_meet_targets(docs, block):
    got = mixing.words_taken(docs, block=block).collect()
    sizes = {d: len(SPACE_WORDS.findall(t or "")) for d, t in texts()}
    assert {r.doc_id: r["size"] for r in got} == sizes
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 0.5 and target[s] <= 3 * size[s] + 1e-9 for s in target)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.words_taken(docs, block=block).collect()), key=str)


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Water-filling by hand: sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, rest, left = {}, set(order), float(sum(sizes.values()))
    while rest:
        level = left / sum(weight[s] for s in rest)
        full = {s for s in rest if most * sizes[s] <= level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in rest}
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        rest -= full
    return target


def test_targets_and_taken_words_by_hand(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 90)), [None, "b", "a", "ü", "tiny"][i % 5] if i % 5 < 4 or i < 10 else "a") for i in range(120)] + [(None, "x y z", "b"), (None, "x y z", "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, rank string")
    got = mixing.words_taken(df, block=8).collect()
    sizes = collections.Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += len(t.split())
    told = plain_targets(sizes)
    assert 3 * sizes["tiny"] == told["tiny"]
    assert all(abs(r.target - told[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in got)
    # blocks by hand: the documents of a source laid end to end, its slots put back on them
    sized = mixing.measure(df).cache()
    sources = mixing.targets(sized)
    placed = mixing.place_documents(sized, sources).collect()
    slots = collections.defaultdict(list)
    for x in mixing.draw_slots(sources, block=8).collect():
        slots[x["rank"]].append((x.block, x.take))
    expected = collections.Counter()
    for p in placed:
        own = range(p.start, p.start + p["size"])
        expected[p.doc_id, p.source, p["size"]] += sum(len(range(max(own.start, b * 8), min(own.stop, b * 8 + take))) for b, take in slots[p["rank"]])
    counted = collections.Counter()
    for r in got:
        counted[r.doc_id, r.source, r["size"]] += r.taken
    assert counted == expected


@pytest.mark.parametrize("cohort", [100_000, 2])
def test_every_shard_is_full_and_draws_by_weight(spark, cohort):
    sources = spark.createDataFrame([(f"s{i}", 64 * 500 * (i + 1), i, 64.0 * 400 * (i + 1)) for i in range(5)], "source string, source_size long, rank long, target double")
    got = collections.Counter((r.shard, r["rank"]) for r in mixing.draw_slots(sources, shard_blocks=1000, cohort=cohort).collect())
    assert [sum(n for (s, _), n in got.items() if s == shard) for shard in range(6)] == [1000] * 6
    assert [sum(n for (_, r), n in got.items() if r == rank) for rank in range(5)] == [400 * (i + 1) for i in range(5)]
    assert all(abs(got[s, r] - 1000 * (r + 1) / 15) < 90 for s in range(6) for r in range(5)) and len({got[s, 0] for s in range(6)}) > 1


@given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.floats(0, 1), st.integers(1, 40), st.integers(0, 99))
@settings(max_examples=200, deadline=None)
def test_draws_in_units_keep_totals(counts, share, largest, seed):
    counts = np.array(counts, np.int64)
    slots = int(share * counts.sum())
    got = mixing.split_counts(counts, slots, seed, largest=max(largest, len(counts) + 1))
    assert got.sum() == slots and (got >= 0).all() and (got <= counts).all()


def test_draws_beyond_the_largest_are_shared_by_size():
    counts = np.array([1, 2, 3, 4], np.int64) * 10**12 + 7
    for seed in range(20):
        got = mixing.split_counts(counts, 3 * 10**12 + 5, seed)
        assert got.sum() == 3 * 10**12 + 5 and (abs(got / counts - 0.3) < 1e-3).all()
    assert len({tuple(mixing.split_counts(counts, 10**12, seed)) for seed in range(5)}) == 5


@pytest.mark.parametrize("repeated", [False, True])
def test_mix_holds_what_words_taken_counts(docs, repeated):
    docs = docs.unionByName(docs.filter("doc_id < 4")) if repeated else docs
    blocks = mixing.mix(docs, block=16).collect()
    counted = collections.Counter()
    for r in mixing.words_taken(docs, block=16).collect():
        counted[r.source] += r.taken
    said = collections.Counter()
    for b in blocks:
        assert len(b.text.split(" ")) == b.n_words <= 16
        said[b.source] += b.n_words
    assert said == +counted


def test_mix_of_nothing(docs):
    assert mixing.words_taken(docs.limit(0)).count() == 0 and mixing.mix(docs.filter("text = ''")).count() == 0


# --- url filters


def test_rules_and_patterns(spark):
    urls = ["http://A.Example.NET/en/x?y", "http://a.example.net/de/x", "https://net/", "https://net", "http://cheap-pills.example.com/de/1", "http://cheap-pills.example.com/fr/1", "no scheme", "", None, "http://x.org/fr/a", "HTTP://WWW.CASINO-WIN.ORG", "http://notnet/en/", "http://h/adserver/x"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    got = [tuple(r) for r in url_filter.judge_urls(pages).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("a.example.net", "/de/x", "net/", "block"), ("net", "/", "net/", "block"), ("net", "", None, "allow"),
        ("cheap-pills.example.com", "/de/1", "example.com/de/", "block"), ("cheap-pills.example.com", "/fr/1", None, "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("x.org", "/fr/a", "org/fr/", "allow"), ("www.casino-win.org", "", None, "block"), ("notnet", "/en/", None, "allow"), ("h", "/adserver/x", None, "block"), ("a.example.net", "/en/x", "example.net/en/", "allow"),
    ]


@pytest.mark.parametrize("most", [url_filter.MOST_RULES, 0])
def test_rules_as_tables_empty_tables_and_long_urls(spark, most):
    first, second = url_filter.rule_tables(spark, url_filter.PATTERN_RULES, [*url_filter.HOST_RULES, ("block", "noslash")])
    urls = ["http://a.example.net/de/" + "x/" * 50_000, "http://" + "a." * 20_000 + "net/", "http://cheap-pills.x/" + "y" * 100_000, "http://ok/", None]
    pages = spark.createDataFrame([(u, "c", "c") for u in urls], "url string, row string, _url string")
    got = url_filter.judge_urls(pages, patterns=first, hosts=second, most=most)
    assert [r.verdict for r in sorted(got.collect(), key=lambda r: urls.index(r.url))] == ["block", "block", "block", "allow", "allow"] and {r.row for r in got.collect()} == {"c"}
    assert url_filter.judge_urls(pages.limit(0), most=most).count() == 0 and url_filter.judge_urls(pages, patterns=(), hosts=()).filter("verdict = 'allow'").count() == 5


@pytest.mark.parametrize("most", [url_filter.MOST_RULES, 0])
def test_index_finds_what_all_rules_find(spark, sf_dir, most):
    pages = table(spark, sf_dir, "pages")
    got = {r.url: r.verdict for r in url_filter.judge_urls(pages, hosts=(), most=most).collect()}
    assert got == {u: "block" if any(re.search(p, low(u)) for p, _ in url_filter.PATTERN_RULES) else "allow" for u in got}


def test_every_alternative_of_a_pattern_is_found(spark):
    hosts = "cheap-pills casino-win free-bets ads-track spam-farm online-casino casino-x1 online-casino-x1 casino pill-shop pills-shop pill-store pills-store a-pill-shop payday-loan payday-loans adult-x porn porn-x xxx xxx-x torrent-x warez-x"
    blocked = [f"http://{h}.x/" for h in hosts.split()] + ["http://h/adserver.js", "http://h/a/adclick?", "http://h/?click_id=1&aff_id=2"]
    urls = [*blocked, "http://pill.x/", "http://shop.x/", "http://pillar-shop.x/"]
    for p, tokens_ in url_filter.PATTERN_RULES:
        fits = [u for u in urls if re.search(p, u)]
        assert fits and all(set(t.split("|")) & set(re.split("[^a-z0-9]+", u)) for t in tokens_ for u in fits)
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url for r in url_filter.judge_urls(pages, hosts=()).collect() if r.verdict == "block"} == set(blocked)


# --- near duplicates


def component_ids(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = SPACE_WORDS.findall(low(t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[a] < label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[b] = label[a]
                    changed = True
    return {d: (len(sets[d]), label[d], label[d] == d) for d in sets}


def hub(rng, copies=40):
    """A hub to which all are linked, while few are linked among themselves."""
    words = [f"w{i}" for i in range(400)]
    out = [(1000, " ".join(words))]
    for i in range(copies):
        own = list(words)
        for p in rng.choice(400, 6, replace=False):
            own[p] = f"v{i}x{p}"
        out.append((1001 + i, " ".join(own)))
    return out


@pytest.mark.parametrize(("k", "percent", "small"), [(5, 80, 16), (3, 96, 2)])
def test_components(spark, monkeypatch, k, percent, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    rows = texts() + hub(np.random.default_rng(3))
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, n_shingles string").repartition(4)
    got = by_id(minhash.near_duplicates(df, k=k, percent=percent), "n_shingles", "component_id", "kept")
    assert got == component_ids(rows, k, percent)


def test_components_of_null_ids_repeated_rows_and_nothing(spark):
    schema = "doc_id long, text string"
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, schema), k=3, percent=85).collect()
    assert sorted(tuple(r) for r in got if r.doc_id) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 2, None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert minhash.drop_near_duplicates(spark.createDataFrame(rows, schema), k=3).count() == 4


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.sort(pool[:1000]), np.sort(pool[100:1100]), np.sort(pool[1500:1510]), pool[:1]]
    h = minhash.superminhash(sets, 168)
    assert np.isfinite(h).all() and all(sorted(np.floor(h[3]).astype(int)) == list(range(168)) for _ in (0,))
    assert abs((h[0] == h[1]).mean() - 900 / 1100) < 0.12 and (h[0] == h[2]).mean() == 0


# --- repeats


def removed(rows, length=200):
    data = {d: (t or "").encode() for d, t in rows}
    seen = collections.Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("group", [repeats.GROUP_ROWS, 3])
def test_repeats(spark, docs, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group)
    monkeypatch.setattr(repeats, "MOST_STRINGS", 500)
    rng = np.random.default_rng(5)
    say = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = say(260)
    extra = [(100 + i, say(int(rng.integers(0, 300))) + passage[: int(rng.integers(150, 261))] + say(50)) for i in range(12)]
    own = [(d, t) for d, t in texts() if group > 3 or t != "x" * 5000]  # each length of it would be a round
    rows = own + extra
    df = docs.join(spark.createDataFrame([(d,) for d, _ in own], "doc_id long"), "doc_id").select("doc_id", "text", F.lit("clash").alias("n_bytes")).unionByName(spark.createDataFrame([(d, t, "c") for d, t in extra], "doc_id long, text string, n_bytes string"))
    assert by_id(repeats.remove_repeats(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows)


def test_repeats_of_repeated_rows_and_nothing(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(250))
    df = spark.createDataFrame([(1, t), (1, t), (None, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(df).collect()) == [(0, 0, 0), (250, 250, 1), (250, 250, 1)]
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_texts_without_repeats_do_not_move(spark, tmp_path):
    """op7 at 6 GB: its shuffle files held every text and every step's rows at once."""
    rng = np.random.default_rng(7)
    say = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöü"), n))
    passage = say(5000)
    rows = [(i, say(20_000)) for i in range(40)] + [(200 + i, say(90) + passage) for i in range(3)] + [(300, twin := say(2000)), (301, twin), (302, ""), (303, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f: f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    out = repeats.remove_repeats(docs, keep_bytes=False)
    out.write.parquet(f"{tmp_path}/out")
    moved, until = lambda: sum(n for f, n in files().items() if f not in before), time.time() + 20
    while moved() > 200_000 and time.time() < until:  # files go a moment after their step
        time.sleep(0.5)
    assert moved() < 200_000 < sum(len(t or "") for _, t in rows) / 4
    assert by_id(spark.read.parquet(f"{tmp_path}/out"), "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in repeats.remove_repeats(docs).select("kept", "kept_sha256").collect())


def all_repeats(rows, length=200):
    """Each string of ``length`` bytes that starts at two places at least, with its places."""
    seen = collections.defaultdict(set)
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].add((d, i))
    return {s: p for s, p in seen.items() if len(p) > 1}


@pytest.mark.parametrize("group", [repeats.GROUP_ROWS, 3])
def test_repeat_groups_have_all_occurrences(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group)
    rng = np.random.default_rng(6)
    say = lambda n: "".join(rng.choice(list("abcdéfgh "), n))
    passage, far = say(260), say(700)
    rows = [(i, say(int(rng.integers(0, 200))) + passage[: int(rng.integers(190, 261))] + say(40)) for i in range(10)]
    rows += [(20, say(50) + far + say(30)), (21, far + "z"), (22, say(300)), (23, None), (24, ""), (25, "short")]
    groups, members, sites = repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {tuple(r)[1:]: r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", *repeats.text_key("text")).collect()}
    data = {d: (t or "").encode() for d, t in rows}
    found = collections.defaultdict(set)
    for r in repeats.occurrences(groups, members, sites).collect():
        found[r.tree, r["first"], r["last"], r.length].add((ids[r.k, r.m], r.start))
    most = collections.defaultdict(set)
    for (_, _, _, n), places in found.items():
        assert len(places) > 1 and n >= 200 and len({data[d][s : s + n] for d, s in places}) == 1
        d, s = next(iter(places))
        for o in range(n - 199):
            most[data[d][s + o : s + o + 200]] |= {(d, s + o) for d, s in places} if len(places) >= len(most[data[d][s + o : s + o + 200]]) else set()
    assert dict(most) == all_repeats(rows)


def test_copies_and_periodic_texts_stay_linear(spark):
    t = "x" * 5000
    copy = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(900))
    docs = spark.createDataFrame([(1, t), (2, copy), (3, copy)], "doc_id long, text string")
    groups, members, sites = (x.toPandas() for x in repeats.repeat_groups(docs))
    assert len(groups) + len(members) < 100_000 and len(sites) < 6_000
    at = sites.groupby(["a", "c"]).size().rename("n").reset_index()
    held = members.merge(at, on=["a", "c"])
    counts = [held[(held.tree == g.tree) & (held["rank"] >= g["first"]) & (held["rank"] <= g["last"])]["n"].sum() for _, g in groups[groups.length == 200].head(20).iterrows()]
    assert max(counts) == 4801  # the places of 200 letters
    keys = [tuple(r) for r in docs.filter("doc_id = 2").select(*repeats.text_key("text")).collect()]
    own = sites[(sites.k == keys[0][0]) & (sites.m == keys[0][1])].merge(members, on=["a", "c"]).merge(groups, on="tree")
    own = own[(own["rank"] >= own["first"]) & (own["rank"] <= own["last"])]
    covered = {b for _, r in own.iterrows() for b in range(r["at"] + r["start"], r["at"] + r["start"] + r["length"])}
    assert covered == set(range(900))


def test_clashing_names_are_replaced_or_kept(spark):
    names = ["k", "m", "_k", "_m", "spans", "_text", "row", "kept"]
    df = spark.createDataFrame([(1, "ab" * 150, *names), (2, None, *names)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    got = repeats.remove_repeats(df, keep_bytes=False).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in got} == {(1, 300, 300), (2, 0, 0)} and all(r[n] == n for r in got for n in names[:-1]) and "kept" not in got[0]


def test_removed_spans_are_occurrences_of_interval_groups(monkeypatch):
    rng = np.random.default_rng(11)
    say = lambda n: bytes(rng.choice(list(b"abcdefgh "), n).tolist())
    scan, seen = repeats.interval_groups, []
    monkeypatch.setattr(repeats, "interval_groups", lambda *x: seen.append(scan(*x)) or seen[-1])
    anchor = say(50)
    before, after = say(150), say(150)
    cuts = [(150, 150), (150, 150), (150, 90), (100, 150), (80, 120), (10, 20)]
    contexts = [say(150 - i) + before[150 - i :] + anchor + after[:j] + say(150 - j) for i, j in cuts]
    a, c, d = np.zeros(len(contexts), np.uint64), np.arange(len(contexts)), np.full(len(contexts), 150)
    spans, trees = repeats.compare_contexts(a, c, d, contexts, groups=True)
    rows = pa.concat_tables(trees).to_pylist()
    groups, members = [r for r in rows if r["a"] is None], [r for r in rows if r["a"] is not None]
    assert sum(map(len, seen)) == len(groups) > 1
    covered = lambda found: [{b for s, e in x for b in range(s, e)} for x in found]
    told = [[(m["start"], m["start"] + g["length"]) for g in groups for m in members if m["c"] == o and m["tree"] == g["tree"] and g["first"] <= m["first"] <= g["last"]] for o in range(len(contexts))]
    seen.clear()
    alone, _ = repeats.compare_contexts(a, c, d, contexts)
    assert seen and alone == spans and covered(spans) == covered(told)
    grams = collections.Counter((s, c[s : s + 200]) for c in contexts for s in range(151))
    assert covered(spans) == [{b for s in range(151) if grams[s, c[s : s + 200]] > 1 for b in range(s, s + 200)} for c in contexts]


def test_interval_groups_are_the_maximal_repeats():
    text = "xabcyabczabc"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(text[a:], text[b:], strict=False)) if x != y), min(len(text) - a, len(text) - b))
    lcp = np.array([0, *(common(a, b) for a, b in zip(order, order[1:], strict=False))])
    left = [{text[i - 1] if i else None} for i in order]
    found = {(text[order[f] : order[f] + n], t - f + 1) for f, t, n in repeats.interval_groups(lcp, left, 1)}
    assert found == {("abc", 3)}


# --- token counts


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    model = Tokenizer.from_file(path)
    got = by_id(tokens.token_counts(docs, path, limit=100), "n_bytes", "n_tokens", "over_limit")
    for d, t in texts():
        n = len(model.encode(t or "", add_special_tokens=False).ids)
        assert got[d] == (len((t or "").encode()), n, n > 100)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@given(st.lists(st.text(alphabet="aB1é .'<|>endoftxstar\n\t ́Σ", max_size=60), max_size=6))
@settings(max_examples=25, deadline=None)
def test_pieces_count_as_whole_texts(name, said):
    import public_tokenizers

    counter = tokens.PieceLengths(str(public_tokenizers.path(name)))
    said = [*said, None, "<|endoftext|> don't", "a  b"]
    assert counter.splits == (name == "word_bpe_49k.json")
    assert counter.of_texts(pa.array(said, pa.string())).tolist() == [int(counter._lengths([t or ""])[0]) for t in said]


def test_boundaries_are_proven_or_not_used():
    import json

    import public_tokenizers

    file = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert tokens.splits_at_space(file)
    split = {"type": "Split", "pattern": {"Regex": r"\w+ ?"}, "behavior": "Removed", "invert": True}
    others = [{"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel"}}, {"pre_tokenizer": split}, {"normalizer": {"type": "Prepend", "prepend": "x"}}, {"added_tokens": [{"content": "a b"}]}]
    assert not any(tokens.splits_at_space(file | x) for x in others) and tokens.splits_at_space(file | {"pre_tokenizer": {"type": "WhitespaceSplit"}})


def test_token_counts_of_nothing_and_clashing_names(spark):
    df = spark.createDataFrame([("a b", "c", "d"), (None, "c", "d"), (None, "c", "d")], "text string, n_tokens string, row string")
    got = tokens.token_counts(df, queries.tokenizer_path()).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2] and {r.row for r in got} == {"d"} and tokens.token_counts(df.limit(0), queries.tokenizer_path()).count() == 0


# --- quality


def test_held_out_rows_are_learnt_from_never_and_told_well(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    got = {r.doc_id: r for r in queries.op9_quality(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    own = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([q == r.predicted for q, r in own]) > 0.9
    wrong = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = table(spark, sf, "documents")
    assert (quality.train(docs, wrong).value == quality.train(docs, labels).value).all()


def test_quality_of_nothing_and_one_label(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    forest = quality.train(docs, labels)
    got = quality.score(docs, forest).collect()
    assert {round(r.score, 6) for r in got} == {0.5} and len(got) == len(texts())
    assert quality.score(docs.limit(0), forest).count() == 0


def test_flat_trees_score_like_nodes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.fit(x, y)

    def one(row):
        total = f.base
        for at in f.roots:
            while f.left[at] != at:
                at = f.left[at] if row[f.feature[at]] <= f.cut[at] else f.right[at]
            total += f.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x[:50]), [one(r) for r in x[:50]]) and ((f.score(x) > 0.5) == y).mean() > 0.9


def test_clashing_names_of_statistics(spark, docs):
    names = ["row", "x", "said", "_x", "_text"]
    df = spark.createDataFrame([(i, t, *names) for i, t in texts()], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(10)], "doc_id long, quality int, y string")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == len(texts()) and all(r[n] == n for r in got for n in names)


# --- personal data

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(t):
    out = []
    for k, (kind, p) in enumerate(RULES.items()):
        for m in p.finditer(t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits or "1"), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


@given(st.text(alphabet="a1@.-_%+ (0)9é42", max_size=80))
@settings(max_examples=400, deadline=None)
def test_base_spans_are_those_of_the_plain_patterns(t):
    assert pii.base_spans(t) == plain_spans(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "+" + "1 " * 100_000, "@" * 100_000, "a.b-" * 100_000):
        assert isinstance(pii.base_spans(t), list)


def test_revealing_terms_and_redaction(spark):
    rng = np.random.default_rng(2)
    common = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(common, 30))) for i in range(200)]
    for i in range(5):
        rows.append((500 + i, " ".join(rng.choice(common, 8)) + " Zanzibar jo@example.org " + " ".join(rng.choice(common, 8))))
    rows += [(900, None), (901, ""), (902, "Zanzibar is far"), (903, rows[-1][1]), (903, rows[-1][1])]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, _text string").select("doc_id", "text")
    got = by_id(pii.find_personal_data(df), "_spans")
    for i in range(5):
        kinds = [(s["kind"], dict(rows)[500 + i][s["start"] : s["end"]]) for s in got[500 + i][0]]
        assert kinds == [("term", "Zanzibar"), ("email", "jo@example.org")]
    assert all(not v[0] for d, v in got.items() if d < 500 or d in (900, 901, 902))
    clean = by_id(pii.sanitise(df), "text")
    assert "[TERM] [EMAIL]" in clean[500][0] and clean[902] == ("Zanzibar is far",) and clean[900] == (None,)
    assert pii.sanitise(df).count() == len(rows) and pii.find_personal_data(df.limit(0)).count() == 0


def test_terms_far_from_a_mention_reveal_it_too(spark):
    rng = np.random.default_rng(4)
    common = [f"wörd{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choice(common, n))
    rows = [(i, say(30)) for i in range(200)]
    for i in range(4):  # the name stands far from the mention, whose surroundings are the same everywhere
        rows.append((500 + i, f"Dear Zanzibar {say(60)} zanzibar, {'yours as ever ' * 6}jo@example.org {'sent by hand ' * 6}"))
    rows += [(600, "Zanzibar"), *((700 + i, rows[-1][1]) for i in range(9)), *((800 + i, f"Copied Quux {rows[0][1]} al@example.org") for i in range(5))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = by_id(pii.find_personal_data(df), "_spans")
    said = dict(rows)
    for d in [*range(500, 504), *range(700, 709)]:
        found = [said[d][s["start"] : s["end"]] for s in got[d][0] if s["kind"] == "term"]
        assert found[:3] == ["Dear", "Zanzibar", "zanzibar"] and set(found[3:]) == {"yours", "as", "ever", "sent", "by", "hand"}
    assert not got[600][0]
    for i in range(5):  # one text in five copies, so its entity is in one text, whose rare words reveal it
        assert [said[800 + i][s["start"] : s["end"]] for s in got[800 + i][0] if s["kind"] == "term"] == ["Copied", "Quux"]
    assert all("anzibar" not in v[0] for d, v in by_id(pii.sanitise(df), "text").items() if d != 600)


def revealed(rows, support=3, disclosure=0.8):
    """Term spans of each row by plain counting over distinct texts."""
    held, words_of, spans = {}, {}, {}
    for t in {t or "" for _, t in rows}:
        spans[t] = plain_spans(t)
        held[t] = {(k, low(t[s:e]) if k in ("email", "ip") else re.sub("[^0-9]", "", t[s:e])) for s, e, k in spans[t]}
        words_of[t] = [(m.start(), m.end(), low(m[0])) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t) if all(m.end() <= s or m.start() >= e for s, e, _ in spans[t])]
    with_term = collections.Counter(w for t in spans for w in {low(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)})
    n, out = len(spans), {}
    n_e = collections.Counter(e for t in spans for e in held[t])
    n_et = collections.Counter((e, w) for t in spans for e in held[t] for w in {w for _, _, w in words_of[t]})
    tells = {(e, w) for (e, w), k in n_et.items() if k >= min(support, n_e[e]) and n > n_e[e] and np.log(n * k / (n_e[e] * max(with_term[w], k))) >= disclosure * np.log(n / n_e[e])}
    for d, t in rows:
        t = t or ""
        terms = [(s, e, "term") for s, e, w in words_of[t] if any((x, w) in tells for x in held[t])]
        order = list(pii.KINDS)
        out[d] = sorted([*spans[t], *terms], key=lambda x: (x[0], order.index(x[2]), x[1]))
    return out


def test_terms_by_plain_counting(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"wörd{int(x)}" for x in rng.zipf(1.4, 400)]
    mails = [f"u{i}@host{i % 3}.example.com" for i in range(12)]
    rows = []
    for i in range(260):
        words_ = [*rng.choice(vocabulary, 20), *(f"Räre{x}" for x in rng.integers(0, 4000, 9))]
        for _ in range(int(rng.integers(0, 3)) if i % 2 else 0):
            who = rng.choice([*mails[:4], mails[i % 12], "10.0.0.7", "+1 (377) 555-0271"])
            words_.insert(int(rng.integers(0, 20)), f"Zu{mails.index(who)} {who}" if who in mails and rng.random() < 0.9 else who)
        rows.append((i, " ".join(words_)))
    rows += [(900, rows[1][1]), (901, None), (902, ""), (903, "Solo x@y.zz")]
    names = ["said", "spans", "id", "k", "m", "entities", "row", "_spans", "added"]
    df = spark.createDataFrame([(*r, *names) for r in rows], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in names)]))
    got = pii.find_personal_data(df).collect()
    assert {r.doc_id: [tuple(x) for x in r["_spans"]] for r in got} == revealed(rows) and all(r[c] == c for r in got for c in names if c != "_spans")
    assert sum(x[2] == "term" for v in revealed(rows).values() for x in v) > 20
    said = {how: by_id(pii.sanitise(df.filter("doc_id IN (903, 901) OR doc_id < 200"), terms=how), "text") for how in ("label", "generalise", "remove")}
    assert [said[how][903][0] for how in said] == ["[TERM] [EMAIL]", "[NAME] [EMAIL]", " [EMAIL]"] and said["label"][901] == (None,)
    assert [pii.generalise(x) for x in ("1234", "a1", "Bo", "bo")] == ["[NUMBER OF 4 DIGITS]", "[CODE]", "[NAME]", "[WORD]"]


# --- the pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, seen[-1], sf_dir)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], i
        seen.append(spark.createDataFrame(out.toArrow(), docs.schema))
    ids = [{r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in seen]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:], strict=False))
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in ids[1] for d in good) >= 0.95 * len(good)
    kept = component_ids(sorted(ids[1].items()), 5, 80)
    assert set(ids[2]) == {d for d, (_, _, stays) in kept.items() if stays}
    again = decontaminate.find_leaks(seen[3], table(spark, sf_dir, "benchmark"))
    assert again.filter("n_hit > 0").count() <= 1
    assert all(not plain_spans(t) for t in ids[4].values() if t)
    mixed = corpus_pipeline.STAGES[4][1](spark, seen[4], sf_dir)
    assert mixed.filter("n_words > 64 or n_words < 1").count() == 0


def test_stages_take_nulls_repeated_rows_and_nothing(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    none = {f.name: None for f in docs.schema}
    odd = [none, none | {"doc_id": 10**9}, none | {"doc_id": 10**9 + 1, "text": ""}, none | {"doc_id": 10**9 + 2, "text": "same words again"}, none | {"doc_id": 10**9 + 2, "text": "same words again"}, none | {"doc_id": 10**9 + 3, "text": "mail me at a.b@c.de " * 3000}]
    rows = spark.createDataFrame([tuple(r[f.name] for f in docs.schema) for r in odd], docs.schema)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows.unionByName(docs.limit(20)) if i == 0 else rows, sf_dir)
        assert out.count() > 0, name
        assert stage(spark, rows.limit(0), sf_dir).count() == 0, name
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, rows, sf_dir)
    assert kept.count() == len(odd)
