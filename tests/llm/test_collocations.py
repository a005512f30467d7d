"""Phrase mining against a count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from wardlens.llm import collocations


def plain(docs, least, longest, limit):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            own = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(own)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i : i + n]] = max(longer[p[i : i + n]], a)
        rows = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer[p] < 80 * a:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def corpus(seed, n):
    """Texts with fixed phrases, frequent words, pieces and repeated passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "é", "ÄB", " x", " ", "a_b"]
    phrases = ["new york city hall", "new york", "of the", "hot dog stand", "x y", "ping pong ping pong"]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(40)):
            parts.append(rng.choice(phrases) if rng.random() < 0.4 else vocabulary[int(rng.random() ** 3 * len(vocabulary))])
            parts.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"]))
        texts.append("".join(parts))
    texts += ["Copied passage That Comes again and again in full"] * 9 + ["UPPER case Words"] * 7 + ["", None, " \t\n", "...", "solo"]
    return [(rng.choice(["en", "de", "en", "en", None, "und", ""]), t) for t in texts]


@pytest.mark.parametrize("limit", [3, 40, 2000])
def test_phrases_match_a_count_of_all(spark, limit):
    docs = corpus(limit, 300)
    frame = spark.createDataFrame([(*d, 7, "x") for d in docs], "lang string, text string, f long, phrase string").repartition(4)
    found = collocations.collocations(frame, least=4, limit=limit)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain(docs, 4, 4, limit)


def test_level_is_lowered_until_enough_survive(spark):
    # the best pairs all lie in longer phrases and are dropped, so the survivors are found far below the first level
    docs = [("en", f"a{k} b{k} c{k} d{k}") for k in range(30) for _ in range(5)]
    docs += [("en", " ".join(f"p{k} q{k}. p{k}. q{k}. p{k} z." for _ in range(5))) for k in range(20)]
    frame = spark.createDataFrame(docs, "lang string, text string")
    found = collocations.collocations(frame, least=5, limit=45)
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == plain(docs, 5, 4, 45) and len(rows) == 45


def test_long_text_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_BLOCK", 1000)
    text = " ".join(["alpha beta gamma."] * 500) + " " + "no break " * 400
    blocks = list(collocations._cut(text.lower().encode().translate(collocations._CLEAN)))
    assert len(blocks) > 5
    total = Counter()
    for block in blocks:
        phrases, counts = collocations._grams("en", block, 2, None, None)
        total.update(dict(zip(phrases.to_pylist(), counts.tolist())))
    assert total[b"alpha beta"] == 500 and total[b"no break"] == 400 and total[b"break no"] == 399


def test_ratio_beyond_64_bits(spark):
    big = 9 * 10**18
    row = spark.range(1).select(collocations.ratio(F.lit(big), F.lit(big), F.lit(big - 1)).alias("x")).first()
    assert row.x == 2_000_000 * big // (2 * big - 1)


def test_empty_documents(spark):
    frame = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(frame).collect() == []
    frame = spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")
    assert collocations.collocations(frame).collect() == []
