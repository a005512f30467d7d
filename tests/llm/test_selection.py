"""Quality rules, mixtures, language-model scores and the pipeline against plain recomputation."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from wardlens.llm import budgets, circulant, class_lm, risk_rules
from wardlens.llm.words import shingle_set, words_of


def plain_measures(text):
    words = (text or "").encode().split()
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_measures_match_plain_counts(spark):
    rng = random.Random(2)
    texts = ["", None, " ", "a", "a b", "a a a", "a a a a", "x\ny\n\nx\n x", "#é* <b>☃ \x0b\x0cz", "a b c " * 4000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, measures int")
    name = "measures_"
    found = {r.doc_id: r[name] for r in risk_rules.measured(frame, name).collect()}
    for k, text in enumerate(texts):
        m = found[k]
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == plain_measures(text), text


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.3), (3, 50, 0.2), (40, 2000, 0.03), (9, 10, 0.99), (4500, 1_000_000, 0.005)])
def test_binomial_tail_is_exact(spark, k, n, p):
    found = spark.range(1).select(risk_rules.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first().x
    exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
                               + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert found == pytest.approx(exact, rel=1e-6) and found >= exact * (1 - 1e-6)


def test_cutoffs_reject_junk_within_the_risk(spark):
    rng = random.Random(4)

    def words(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    rows, labels = [], []
    for k in range(3000):
        junk = k % 6 == 0
        rows.append((k, words(55) + (" #$%" * 40 if junk else ""), "en" if k % 10 else None, 1))
        labels.append((k, 0 if junk else 1, 0))
    rows += [(5000, None, "en", 1), (5001, "short", "en", 1), (None, words(60), "xx", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, measures int")
    graded = spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    found, name = risk_rules.judged(docs, graded)
    assert found.columns[: len(docs.columns)] == docs.columns
    kept = {r.doc_id: r[name].kept for r in found.collect()}
    assert len(kept) == len(rows)
    assert all(kept[k] == (k % 6 != 0) for k in range(3000) if k % 10)  # the large stratum is proven
    assert all(kept[k] for k in range(0, 3000, 10))  # the small one proves nothing, so nothing is rejected
    assert not kept[5000] and not kept[5001] and kept[None]
    empty, name = risk_rules.judged(docs.limit(0), graded.limit(0))
    assert empty.collect() == []


def plain_budget(children, budget):
    """Water-filling by repeated sharing: children are name -> (weight, capacity)."""
    given, open_ = dict.fromkeys(children, 0.0), set(children)
    while open_ and budget > 1e-9:
        total = sum(children[c][0] for c in open_)
        full = {c for c in open_ if children[c][1] <= budget * children[c][0] / total}
        if not full:
            for c in open_:
                given[c] = budget * children[c][0] / total
            break
        for c in full:
            given[c] = children[c][1]
        budget -= sum(children[c][1] for c in full)
        open_ -= full
    return given


def test_budgets_and_prefixes(spark):
    rng = random.Random(8)
    rows = []
    for k in range(1200):
        domain = rng.choice("ab")
        rows.append((k, domain, "en" if k % 3 else "de", f"s{rng.randrange(3)}" if k % 5 else None, rng.randrange(0, 30), 7))
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, size int, budget int")
    weights = {("a",): 3.0, ("b",): 1.0, ("a", "de"): 9.0, ("b", "en", "s1"): 0.0}
    path = ["domain", "lang", "source"]
    taken = {r.doc_id: r for r in budgets.mixed(docs, path, F.col("size"), weights, 0.7, 2, 5).collect()}
    tokens = Counter()
    for _, d, lang, s, n, _ in rows:
        tokens[d, lang, s or ""] += n

    def descend(prefix, budget, depth):
        if depth == 3:
            return {prefix: budget}
        children = {}
        for leaf in tokens:
            if leaf[:depth] == prefix:
                w = weights.get(leaf[: depth + 1], 1.0)
                children.setdefault(leaf[: depth + 1], [w if w > 0 else 1e-9, 0])[1] += 2 * tokens[leaf]
        out = {}
        for child, share in plain_budget(children, budget).items():
            out |= descend(child, share, depth + 1)
        return out

    plan = descend((), math.floor(0.7 * sum(tokens.values())), 0)
    got = Counter()
    for _, d, lang, s, n, _ in rows:
        got[d, lang, s or ""] += 0
    for k, d, lang, s, n, _ in rows:
        got[d, lang, s or ""] += n * (taken[k].n_copies if k in taken else 0)
    for leaf, budget in plan.items():
        assert budget - 30 < got[leaf] <= budget + 1, leaf
    again = {r.doc_id: r.n_copies for r in budgets.mixed(docs.repartition(7), path, F.col("size"), weights, 0.7, 2, 5).collect()}
    assert again == {k: r.n_copies for k, r in taken.items()}
    assert budgets.mixed(docs.limit(0), path, F.col("size"), weights, 0.7).collect() == []


def test_class_scores(spark):
    rng = random.Random(11)
    nouns, verbs = [f"n{k}" for k in range(12)], [f"v{k}" for k in range(12)]
    texts = [" ".join(x for _ in range(rng.randrange(1, 12)) for x in (rng.choice(nouns), rng.choice(verbs))) for _ in range(400)]
    texts += [None, "", "N1 Über never seen" + str(rng.random())]
    rows = [(k, t, k % 7 == 2 or None if k % 7 in (2, 3) else False, 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean, score int").repartition(3)
    found = {r.doc_id: r for r in class_lm.class_scores(docs, F.col("held"), lexicon=1000, classes=4).collect()}
    tokens = {k: (t or "").encode().lower().split() + [None] for k, t, _, _ in rows}
    counts = Counter(w for k, _, held, _ in rows if held is False for w in tokens[k])
    total, distinct = sum(counts.values()), len(counts)
    for k, _, held, _ in rows:
        r = found[k]
        assert r.held_out == (held is not False) and r.n_tokens == len(tokens[k]) and r.train_tokens == total
        assert r.n_known == sum(counts[w] > 0 for w in tokens[k])
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[k]))
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)  # both negative: alternation is learned
    assert class_lm.class_scores(docs.limit(0), F.col("held")).collect() == []
    none = class_lm.class_scores(docs.limit(3), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in none)


def test_best_class_gain_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(1)
    n, classes = 12, 3
    pairs = rng.integers(0, 20, (n, n)).astype(float)
    state = np.arange(n) % classes

    def value(now):
        table = np.zeros((classes, classes))
        np.add.at(table, (now[:, None], now[None, :]), pairs)
        h = class_lm._entropy
        return h(table).sum() - h(table.sum(0)).sum() - h(table.sum(1)).sum(), table

    for w in range(n):
        before, table = value(state)
        out, into = (np.bincount(state, x, classes) for x in (pairs[w], pairs[:, w]))
        target, gain = class_lm.best_class(state[w], table, out, into, pairs[w, w], classes)
        moved = state.copy()
        moved[w] = target
        assert value(moved)[0] - before == pytest.approx(gain)


def test_rare_words_get_the_class_of_the_highest_likelihood():
    rng = np.random.default_rng(3)
    n, classes = 30, 3
    pairs = rng.integers(0, 4, (n, n)) * rng.integers(0, 2, (n, n)) * rng.integers(1, 30, (n, 1)).astype(float)
    state = np.concatenate([np.arange(14) % classes, np.full(15, classes), [classes + 1]])  # fifteen rare words, one end

    def table_of(now):
        table = np.zeros((classes + 2, classes + 2))
        np.add.at(table, (now[:, None], now[None, :]), pairs)
        return table

    h = class_lm._entropy
    fixed = class_lm.FixedTable(table_of(state), classes)
    for w in np.flatnonzero(state == classes):
        values = []
        for k in range(classes):
            moved = state.copy()
            moved[w] = k
            table = table_of(moved)
            values.append(h(table).sum() - h(table.sum(0)).sum() - h(table.sum(1)).sum())
        other = np.arange(n) != w
        out, into = (np.bincount(state[other], x[other], classes + 2) for x in (pairs[w], pairs[:, w]))
        assert fixed.best(out[None], into[None], pairs[w, w][None])[0] == np.argmax(values)


def test_words_below_the_lexicon_have_classes(spark):
    rng = random.Random(4)
    nouns, verbs = [f"n{k}" for k in range(4)], [f"v{k}" for k in range(4)]
    rare = [(f"rn{k}", f"rv{k}") for k in range(150)]
    texts = [" ".join(x for _ in range(6) for x in (rng.choice(nouns), rng.choice(verbs))) for _ in range(300)]
    texts += [f"{noun} {rng.choice(verbs)} {rng.choice(nouns)} {verb}" for noun, verb in rare for _ in range(2)]
    held = [f"{a} {d} {b} {c}" for (a, c), (b, d) in zip(rare, rare[1:])]
    swapped = [" ".join(reversed(t.split())) for t in held]
    rows = [(k, t, False) for k, t in enumerate(texts)] + [(1000 + k, t, True) for k, t in enumerate(held)] \
        + [(2000 + k, t, True) for k, t in enumerate(swapped)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    found = {r.doc_id: r for r in class_lm.class_scores(docs, F.col("held"), lexicon=60, classes=4).collect()}
    assert all(found[k].n_known == 5 for k in found if k >= 1000)
    # only rare words, in pairs never seen: with one class for all of them both orders would score alike
    assert all(found[1000 + k].score > found[2000 + k].score + 2 for k in range(len(held)))


def test_class_scores_are_a_distribution():
    rng = np.random.default_rng(5)
    full = rng.integers(0, 9, (2, 5, 2, 5)).astype(float)
    full[:, 3], full[:, :, :, 3] = 0, 0
    full[1, 4], full[:, :, 1, 4] = 0, 0
    n_class = full.sum(axis=(0, 1, 2))
    for each, sizes in ((full, n_class), (np.zeros_like(full), np.zeros(5))):
        step = 10 ** class_lm.transition_scores(each, sizes, 3)
        words = np.where(np.arange(5) < 3, np.maximum(sizes, 1), 1)  # what all words of a class have together
        assert (step * words).sum(axis=1) == pytest.approx(np.ones(5))


def test_pipeline_mixture_keeps_every_clean_document(spark):
    import corpus_pipeline

    rows = [(k, "word " * (1 + k % 90), "en" if k % 5 else "de", f"s{k % 3 if k % 4 else 0}", "x", 7) for k in range(300)]
    rows += [(300, "long " * 5000, "en", "s0", "x", 7), (301, "", "fr", "s1", "x", 7), (302, None, None, None, "x", 7)]
    rows += [(5, "another text", "en", "s9", "y", 8), (None, "no id", "es", "s2", "y", 8), (None, "no id either", "es", "s2", "y", 8)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, domain string, n_tokens int").repartition(4)
    kept = corpus_pipeline.source_mixture(spark, docs, "")
    assert kept.columns == docs.columns
    seen = Counter(tuple(r) for r in kept.collect())
    assert set(seen) == set(rows) and max(seen.values()) <= corpus_pipeline.EPOCHS and max(seen.values()) > 1


def test_mixture_moves_towards_its_weights(spark):
    rows = [(k, "a", "x" if k % 10 else "y", 10) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, side string, size long")
    found = budgets.mixed(docs, ["side"], F.col("size"), {("x",): 1.0, ("y",): 1.0}, 1.0, 3, 5, at_least_once=True)
    copies = {r.side: r.n for r in found.groupBy("side").agg(F.sum("n_copies").alias("n")).collect()}
    assert copies == {"x": 900, "y": 300}  # a tenth catches up as far as three epochs reach
    assert found.count() == 1000


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(9, text, "a"), (2, text, "b"), (None, text, "c"), (2, "other words that share an id with a copy", "d"),
            (None, "a text without an id that nothing is like", "e"), (None, "another text of nobody that stays as well", "f"),
            (4, None, "g"), (4, "", "h"), (None, " ", "i"), (7, text + " ten", "j"), (2, text, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string").repartition(3)
    kept = sorted(r._kept for r in circulant.one_of_each_group(docs).collect())
    assert kept in (sorted("bdefghi"), sorted("kdefghi"))  # b and k are the same row but for their mark
    assert circulant.one_of_each_group(docs.limit(0)).collect() == []


def plain_pipeline(rows):
    """Doc ids each stage must keep, by a plain reading: the base rule, then components of equal five-word sets."""
    good = []
    for doc_id, text in rows:
        n, *_, repeats = plain_measures(text)
        if n >= 50 and 100 * repeats <= 50 * n:
            good.append((doc_id, text))
    sets = [shingle_set(words_of(t), 5) for _, t in good]
    group = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (doc_id, _), g in zip(good, group):
        least[g] = min(least.get(g, (True, 0)), (doc_id is None, doc_id or 0))
    return good, least


def test_pipeline_matches_a_plain_reading(spark, tmp_path):
    """Null and shared ids, clashing names, copies: rows are followed through every stage by their text."""
    import corpus_pipeline

    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 90))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:10]] + texts[:5] + ["same " * 80, "", None]
    rows = [(k % 30 if k % 7 else None, t) for k, t in enumerate(texts)]
    full = [(i, t, "en" if k % 3 else "de", f"s{k % 5}", 1, "m") for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_tokens int, measures string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    good, least = plain_pipeline(rows)
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality_rules"](spark, docs, str(tmp_path))
    assert sorted((r.doc_id or -1, r.text) for r in one.collect()) == sorted((i or -1, t) for i, t in good)
    two = stage["minhash_dedup"](spark, one, str(tmp_path)).collect()
    assert len(two) == len(least)
    assert Counter(r.doc_id for r in two) == Counter(None if none else i for none, i in least.values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    codec = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {tuple(codec.encode(r.text, add_special_tokens=False).ids + [0]) for r in two}
    found = {tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in packed}
    assert found == expected and all(r.length == len(r.ids) // 4 for r in packed)
    used = Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("h", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        assert after.select("doc_id").subtract(docs.select("doc_id")).isEmpty()
        assert stage(spark, docs.limit(0), folder).collect() == []
        docs = after.checkpoint()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_exchange_steps_read_bytes_and_count_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    pairs = Counter((rng.randrange(12), rng.randrange(12)) for _ in range(90))
    pairs.update({(13, k): k + 1 for k in range(12)})  # nothing comes before the end, and code 12 never comes
    table = spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a int, b int, n long").repartition(5)
    kept = {}
    monkeypatch.setattr(class_lm, "stored", lambda df, name, *rest: kept.setdefault(name, df.persist()))
    state, counts = class_lm.exchange(table, 12, classes=3)
    assert {f.dataType.simpleString() for f in kept["neighbours"].schema if f.name != "w"} == {"binary"}
    whole = np.zeros((5, 5), np.int64)
    for (a, b), n in pairs.items():
        whole[state[a], state[b]] += n
    assert (counts == whole).all() and set(state[:12]) <= {0, 1, 2} and state[12:].tolist() == [3, 4]
    kept.clear()
    state, counts = class_lm.exchange(table.limit(0), 0, classes=3)
    assert state.tolist() == [3, 4] and not counts.any()


def test_blocks_of_words_hold_codes_and_no_text(tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Alpha", "beta", "gamma-delta", "É"]) for _ in range(300)) + " \n" for _ in range(1200)] + ["", " "]
    rows = pa.table({"doc_id": range(len(texts)), "text": texts})
    n_bytes = rows.nbytes
    with pa.OSFile(str(tmp_path / "rows"), "wb") as file, pa.ipc.new_stream(file, rows.schema) as out:
        out.write_table(rows, max_chunksize=100)
    del rows
    for given, numbered in (([b"beta"], True), ([b"beta", b"alpha"], False)):
        before = pa.total_allocated_bytes()
        blocks, seen = class_lm._Blocks(given, **({} if numbered else {"numbered": False})), 0
        for _, words, parts in blocks.walk(iter(pa.ipc.open_stream(pa.OSFile(str(tmp_path / "rows"), "rb"))), 1):
            assert pa.total_allocated_bytes() - before < n_bytes / 10  # neither texts nor copies of their words
            assert words[: len(given)] == given
            for (doc_ids,), codes, lengths in parts:
                for k, own in zip(doc_ids.to_pylist(), np.split(codes, np.cumsum(lengths)[:-1])):
                    expected = [w.encode() for w in texts[k].replace("A", "a").split()]
                    assert len(own) == len(expected)
                    if numbered:
                        assert [words[c] for c in own] == expected
                    else:
                        assert own.tolist() == [given.index(w) if w in given else len(given) for w in expected]
                    seen += 1
        assert seen == len(texts)
        assert len(words) == (4 if numbered else 2)


def test_bigrams_are_summed_as_they_come(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "PAIRS", 3, raising=False)
    monkeypatch.setattr(class_lm, "SLICE", 2)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(9))) for _ in range(60)] + [None, " A "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    expected = Counter()
    for t in texts:
        line = [3] + [min("abcde".index(w), 2) for w in (t or "").lower().split()] + [3]
        expected.update(zip(line, line[1:]))
    found = class_lm.bigrams(docs.na.fill(""), [b"a", b"b"]).collect()
    assert {(r.a, r.b): r.n for r in found} == expected
