"""Manifest trees against a plain loop: null groups, lone leaves, repeated and null ids, empty tables, clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestream.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    said = [None if v is None else str(v) for v in (row[c] for c in COLUMNS)]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in said))


def climb(nodes, fanout):
    """Each node's steps, and the last hash."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(own):
            first = at // fanout * fanout
            paths[i].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])))
        nodes, own = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)], [at // fanout for at in own]
    return paths, nodes[0]


def plain(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[g] = (members, *climb([leaf_of(r) for r in members], fanout))
    above, root = climb([trees[g][2] for g in order], fanout)
    out = []
    for g, steps in zip(order, above, strict=True):
        members, paths, subroot = trees[g]
        out += [(r["doc_id"], leaf_of(r), subroot, root, tuple(p + steps)) for r, p in zip(members, paths, strict=True)]
    return out


def rows():
    out = []
    for i in range(90):
        lang = ["en", "de", None, "fr"][min(i % 7, 3)] if i < 88 else f"lone{i}"
        out.append({"doc_id": None if i == 11 else i * 3, "source": None if i % 5 == 0 else f"s{i % 3}", "lang": lang, "n_chars": i if i % 4 else None, "text": [None, "", "ü" * 5000, f"Text {i}"][min(i % 9, 3)]})
    return [*out, out[7], out[7], {**out[8], "text": "other text, same id"}, {**out[20], "lang": "", "doc_id": 999}]


@pytest.mark.parametrize("fanout", [3, 8])
def test_manifest_is_that_of_a_plain_loop(spark, fanout):
    data = rows()
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g string, steps string"
    docs = spark.createDataFrame([(*(r[c] for c in COLUMNS), "clash", "clash", "clash") for r in data], schema).repartition(5)
    got = merkle.manifest(docs, fanout=fanout, altered={"text": F.lower("text")})
    seen = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).withColumn("digest", merkle.proof_digest(F.col("steps"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    mine = sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.steps)) for r in seen), key=key)
    assert mine == sorted(plain(data, fanout), key=key)
    assert all(r.folded == r.root and r.digest == h("".join(s.left + s.right for s in r.steps)) for r in seen)
    for r in seen:
        assert r.altered_leaf in {leaf_of({**d, "text": d["text"] and d["text"].lower()}) for d in data if d["doc_id"] == r.doc_id}


def test_changed_rows_are_not_verified(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    data = [(i, "s", "en", 4, f"t{i}") for i in range(20)]
    proofs = merkle.manifest(spark.createDataFrame(data, schema))
    later = [*data[:5], (5, "s", "en", 4, "T5"), (6, "s", "de", 4, "t6"), (99, "s", "en", 4, "t7"), (None, "s", "en", 4, "t8"), data[1]]
    got = merkle.verify(spark.createDataFrame(later, schema), proofs).collect()
    assert sorted((r.doc_id, r.verified) for r in got if r.doc_id is not None) == sorted([*((i, True) for i in range(5)), (1, True), (5, False), (6, False), (99, False)])
    assert [r.verified for r in got if r.doc_id is None] == [False]


@pytest.mark.parametrize("n", [0, 1])
def test_tables_of_one_row_and_of_none(spark, n):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    got = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)][:n], schema)).collect()
    assert [(r.leaf, r.subroot, r.root, r.steps) for r in got] == [(h("1:1----"),) * 3 + ([],)] * n
