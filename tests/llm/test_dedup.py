"""Near-duplicate documents and vectors against brute force, with hot groups and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from wardlens.llm import circulant, quantised
from wardlens.llm.components import components
from wardlens.llm.store import among, stored
from wardlens.llm.words import shingle_set, words_of


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def expected_components(texts, size, percent):
    sets = {i: shingle_set(words_of(t), size) for i, t in texts.items()}
    links = [
        (a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return sets, least_reachable(texts, links)


def near_copies(rng, n, edits):
    """Copies of one text with a few words changed each: some pairs pass the threshold, some do not."""
    base = [f"w{k}" for k in range(60)]
    for k in range(n):
        words = list(base)
        for place in rng.sample(range(60), rng.randrange(edits + 1)):
            words[place] = f"x{k}_{place}"
        yield " ".join(words)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_match_brute_force(spark, size):
    rng = random.Random(size)
    texts = list(near_copies(rng, 60, 5)) + ["same words here again now"] * 20 + ["Same WORDS here again NOW"]
    texts += ["one", "ONE", "two words", "", " \n\t", None, "Ä ä", "ä Ä", "long " * 5000]
    texts += [" ".join(rng.choice("abcdefgh") * 3 for _ in range(40)) for _ in range(20)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets, expected = expected_components(dict(enumerate(texts)), size, 80)
    found = {r.doc_id: r for r in circulant.near_duplicates(docs, size=size).collect()}
    assert set(found) == set(expected)
    for i, r in found.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), expected[i], expected[i] == i), texts[i]


def test_tiles_find_what_stars_leave(spark):
    # a chain: neighbours are near, ends are not
    words = [f"w{k}" for k in range(100)]
    texts = {k: " ".join(words[: 100 - 4 * k] + [f"y{j}" for j in range(4 * k)]) for k in range(8)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, expected = expected_components(texts, 2, 80)
    assert {r.doc_id: r.component_id for r in circulant.near_duplicates(docs, size=2).collect()} == expected


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, "a b c d e f", 5, "z"), (1, "a b c d e f", 5, "z"), (None, "a b c d e f", 5, "z"), (None, "q r s t u v", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep int, fingerprint string")
    found = sorted(circulant.near_duplicates(docs).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in found if r.doc_id] == [(1, 1, True)] * 2
    assert {(r.component_id, r.kept) for r in found if r.doc_id is None} == {(1, False), (None, True)}
    assert circulant.near_duplicates(docs.limit(0)).collect() == []


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2)])
    same = (circulant.signature(a, 240) == circulant.signature(b, 240)).mean()
    assert abs(same - 300 / 500) < 0.12


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 150)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    vectors = np.concatenate([
        np.repeat(centres, 25, axis=0) + rng.standard_normal((150, 16)) * 0.12, np.repeat(centres[:1], 30, axis=0)])
    rows = [(k, v.astype(float).tolist(), k % 2 if k < 150 else 0, "x") for k, v in enumerate(vectors)]
    rows += [(200, None, 0, "x"), (201, [0.0] * 16, 0, "x"), (202, [float("nan")] * 16, 0, "x"),
             (203, [None] + [1.0] * 15, 0, "x"), (204, rows[0][1], None, "x"), (205, [], 0, "x"), (206, [1.0], 0, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id string").repartition(4)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:180]])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    expected = least_reachable(range(180), zip(*np.nonzero(near)))
    found = {r.vec_id: r for r in quantised.near_vectors(frame, 0.98, tile=16).collect()}
    for k in range(180):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (near[k].sum(), expected[k], expected[k] == k)
    for k in range(200, 207):
        assert (found[k].n_links, found[k].component_id, found[k].kept) == (0, k, True)
    assert len(found) == 187 and quantised.near_vectors(frame.limit(0)).collect() == []


def test_quantisation_bound_holds():
    rng = np.random.default_rng(6)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (rng.standard_normal((60, 24)), rng.standard_normal((50, 24))))
    qa, sa, ea, la = quantised.quantise(a)
    qb, sb, eb, _ = quantised.quantise(b)
    rough = (qa.astype(int) @ qb.astype(int).T) * sa[:, None] * sb
    assert (np.abs(rough - a @ b.T) <= ea[:, None] + la[:, None] * eb).all()


def test_rows_among_chosen_keys(spark):
    rows = stored(spark.range(0, 70_000, 1, 3).select(
        F.col("id").alias("n"), F.monotonically_increasing_id().alias("key"), F.lit("x").alias("_bucket_text")), "rows", "zstd")
    wanted = rows.filter("n % 7 = 0 or n < 9 or n > 69990")
    twice = wanted.select("key").union(wanted.select("key")).union(spark.sql("select cast(null as long)"))
    found = among(rows, "key", twice)
    assert found.columns == rows.columns
    assert sorted(r.n for r in found.collect()) == [n for n in range(70_000) if n % 7 == 0 or n < 9 or n > 69_990]
    assert among(rows, "key", twice.limit(0)).collect() == []
    assert among(rows.limit(0), "key", twice).collect() == []


def test_kept_rows_are_stored_as_bits(spark):
    """Texts do not move to be chosen: a table of 20,000 keys is far below the limit that a list of them passes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        docs = spark.range(0, 20_000, 1, 2).selectExpr("id as doc_id", "concat('text ', id % 19000) as text")
        kept = circulant.one_of_each_group(docs)
        assert kept.count() == 19_000
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
