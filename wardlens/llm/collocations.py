"""Phrases whose words belong together, grown best first under bounds from their prefixes' counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .store import stored
from .words import mix

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
LIMIT = 2000  # phrases of a language
SCALE = 2_000_000

# A table of bits has 16 bits a phrase, between these powers of two: 8 kB to 32 MB whatever the corpus holds.
_LEAST_BITS, _MOST_BITS = 16, 28
_PAGE = 1 << 13
_BLOCK = 5 << 20  # bytes of text that are counted together; a longer text is cut between pieces

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_CLEAN = bytes.maketrans(b"\t" + _BREAKS, b" " + b"\n" * len(_BREAKS))
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- counting ---------------------------------------------------------------------------------------------------------

def _cut(data: bytes) -> Iterator[bytes]:
    """Slices of about ``_BLOCK`` bytes that end between pieces."""
    at = 0
    while len(data) - at > _BLOCK:
        end = data.rfind(b"\n", at, at + _BLOCK)
        end = end if end >= 0 else data.find(b"\n", at + _BLOCK)
        if end < 0:
            break
        yield data[at:end]
        at = end + 1
    yield data[at:] if at else data


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts) with A-Z lower-cased, pieces ending in a newline and words in blanks."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            part = whole.slice(start, 256)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text:
                    data = text.encode().lower().translate(_CLEAN)
                    size += len(data)
                    held.setdefault(lang, []).append(data)
            if size > _BLOCK:
                yield from ((lang, block) for lang, texts in held.items() for block in _cut(b"\n".join(texts)))
                held, size = {}, 0
    yield from ((lang, block) for lang, texts in held.items() for block in _cut(b"\n".join(texts)))


def _hashes(hashed: np.ndarray, k: int, lang: str) -> np.ndarray:
    """64-bit hash of every window of k words of a language."""
    total = np.full(len(hashed) - k + 1, np.uint64(k))
    for j in range(k):
        total = total * _ODD + hashed[j : len(hashed) - k + 1 + j]
    return mix(total ^ np.uint64(xxhash.xxh3_64_intdigest(lang)))


def _has(table: bytes, hashed: np.ndarray) -> np.ndarray:
    place = hashed & np.uint64(8 * len(table) - 1)
    return (np.frombuffer(table, np.uint8)[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _grams(
    lang: str, data: bytes, n: int, every: tuple[int, bytes] | None, some: tuple[int, bytes] | None
) -> tuple[pa.Array, np.ndarray]:
    """Distinct phrases of n words inside pieces with their counts.

    All windows of ``every[0]`` words of a phrase must be in its table and one of ``some[0]`` words in its. Words are
    numbered in the block, and so are the phrases of each length, one word after the other.
    """
    tokens = pc.split_pattern(pa.array([data.replace(b"\n", b" \n ")], pa.large_binary()), " ").values.dictionary_encode()
    words, ids = tokens.dictionary, tokens.indices.to_numpy()
    del tokens
    kind = np.full(len(words), 2, np.int8)
    for mark, w in enumerate((b"", b"\n")):
        place = pc.index(words, pa.scalar(w, pa.large_binary())).as_py()
        if place >= 0:
            kind[place] = mark
    if n == 1:
        counts = np.bincount(ids, minlength=len(words))
        return words.filter(pa.array(kind == 2)), counts[kind == 2]
    ids = ids[kind[ids] > 0].astype(np.int64)
    if len(ids) < n:
        return words.slice(0, 0), np.empty(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))[ids]
    inside = kind[ids] == 2
    starts = len(ids) - n + 1
    valid = np.ones(starts, bool)
    for j in range(n):
        valid &= inside[j : starts + j]
    if every:
        k, table = every
        known = _has(table, _hashes(hashed, k, lang))
        for j in range(n - k + 1):
            valid &= known[j : starts + j]
    if some:
        k, table = some
        known = _has(table, _hashes(hashed, k, lang))
        touched = np.zeros(starts, bool)
        for j in range(n - k + 1):
            touched |= known[j : starts + j]
        valid &= touched
    at = np.flatnonzero(valid)
    del hashed, inside, valid
    key, shorter = ids[at], []
    for j in range(1, n):
        key = key * len(words) + ids[at + j]
        if j < n - 1:
            known, key = np.unique(key, return_inverse=True)
            shorter.append(known)
    key, counts = np.unique(key, return_counts=True)
    columns = []
    for known in [None, *reversed(shorter)]:
        key = key if known is None else known[key]
        columns.append(words.take(pa.array(key % len(words))))
        key = key // len(words)
    columns.append(words.take(pa.array(key)))
    return pc.binary_join_element_wise(*reversed(columns), pa.scalar(b" ", pa.large_binary())), counts


def phrase_counts(docs: DataFrame, n: int, every: tuple[int, Broadcast] | None = None, some: tuple[int, Broadcast] | None = None) -> DataFrame:
    """(lang, phrase, f) of the phrases of n words of ``docs`` (lang, text), counted over all texts.

    Equal phrases of a block of texts are one row before the shuffle. The tables of bits only spare phrases that cannot
    matter; a phrase that passes a table by chance is counted as any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [t and (t[0], t[1].value) for t in (every, some)]
        for lang, data in _blocks(batches):
            phrases, counts = _grams(lang, data, n, *tables)
            phrases = phrases.cast(pa.binary()).cast(pa.string())
            for start in range(0, len(phrases), 100_000):
                part = phrases.slice(start, 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), part, pa.array(counts[start : start + 100_000], pa.int64())],
                    ["lang", "phrase", "f"])

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bit_table(spark: SparkSession, phrases: DataFrame) -> Broadcast:
    """The hashes of ``phrases`` (lang, phrase) as a table of bits in every task, of at most 32 MB.

    The bits are set in pages by the tasks; only the pages come to the driver. With more phrases than the largest table
    is made for it lets more others pass, which costs time and changes no result.
    """
    bits = min(max(_LEAST_BITS, (16 * phrases.count()).bit_length()), _MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, bytearray] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = phrase.encode().split(b" ")
                hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
                place = int(_hashes(hashed, len(words), lang)[0]) & ((1 << bits) - 1)
                page = found.setdefault(place // _PAGE, bytearray(_PAGE // 8))
                page[place % _PAGE >> 3] |= 1 << (place & 7)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.int32()), pa.array([bytes(p) for p in found.values()], pa.binary())], ["page", "bits"])

    def joined(table: pa.Table) -> pa.Table:
        page = np.zeros(_PAGE // 8, np.uint8)
        for own in table.column("bits").to_pylist():
            page |= np.frombuffer(own, np.uint8)
        return pa.table({"page": table.column("page")[:1], "bits": pa.array([page.tobytes()], pa.binary())})

    pages = (
        phrases.select("lang", "phrase").mapInArrow(places, "page int, bits binary")
        .groupBy("page").applyInArrow(joined, "page int, bits binary"))
    whole = bytearray((1 << bits) // 8)
    for row in pages.collect():
        whole[row["page"] * (_PAGE // 8) : (row["page"] + 1) * (_PAGE // 8)] = row["bits"]
    return spark.sparkContext.broadcast(bytes(whole))


# ---- scores and bounds ------------------------------------------------------------------------------------------------

def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def ratio(a: Column, l: Column, r: Column) -> Column:  # noqa: E741 - the contract's names
    """floor(2000000 a / (l + r)) without overflow."""
    return F.call_function("div", _wide(a) * F.lit(SCALE).cast("decimal(7,0)"), _wide(l) + _wide(r))


def _part(start: int, n: int) -> Column:
    return F.concat_ws(" ", F.slice(F.split("phrase", " "), start, n))


def _with_counts(found: DataFrame, n: int, known: dict[int, DataFrame]) -> DataFrame:
    """``found`` (lang, phrase, f) with the counts of all its beginnings b1.. and ends e1.., null where not known."""
    for k in range(1, n):
        for name, part in ((f"b{k}", _part(1, k)), (f"e{k}", _part(n - k + 1, k))):
            own = known[k].select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias(name))
            found = found.withColumn("_part", part).join(
                own, (F.col("lang") == F.col("_l")) & (F.col("_part") == F.col("_p")), "left").drop("_l", "_p", "_part")
    return found


def scored(found: DataFrame, n: int) -> DataFrame:
    """Adds ``cut``: (score, k, l, r) of the lowest-scoring cut, and ``bound`` for whatever a phrase can grow into.

    A phrase x that begins with p has a(x) <= f(p), and cutting x after its first word leaves l = f(first word) and
    r >= a(x); so score(x) <= 2000000 f(p) / (f(first word) + f(p)), which no later growth can pass. A cut whose count is
    not known is left out; then ``cut`` is an upper bound.
    """
    a = F.col("f")
    cuts = [
        F.when(F.col(f"b{k}").isNotNull() & F.col(f"e{n - k}").isNotNull(), F.struct(
            ratio(a, F.col(f"b{k}"), F.col(f"e{n - k}")).alias("score"), F.lit(k).alias("k"),
            F.col(f"b{k}").alias("l"), F.col(f"e{n - k}").alias("r")))
        for k in range(1, n)]
    return found.withColumn("cut", F.least(*cuts) if n > 2 else cuts[0]).withColumn(
        "bound", ratio(a, F.col("b1"), a))


def _reached(score: Column) -> Column:
    """(score, f) is at or above the language's level."""
    return F.struct(score.alias("score"), F.col("f").alias("f")) >= F.col("level")


def _best(found: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each language with their ``rank``: first of each share of a language, then of all."""
    shares = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    first = found.withColumn("_share", share).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).filter(F.col("rank") <= limit)
    return first.drop("_share").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= limit)


def _levels(known: DataFrame, open_langs: DataFrame, rank: int) -> DataFrame:
    """(lang, level): score and count of the candidate of that rank; of languages with fewer, one below all others."""
    top = _best(known, rank, F.desc("score"), F.desc("f"), F.asc("phrase"))
    level = top.groupBy("lang").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("score", "f")).alias("_level"))
    nothing = F.struct(F.lit(-1).cast("long").alias("score"), F.lit(-1).cast("long").alias("f"))
    return open_langs.join(level, "lang", "left").select(
        "lang", F.when(F.col("_n") == rank, F.col("_level")).otherwise(nothing).alias("level"))


class Miner:
    """Counts of phrases, kept as they become known, and what follows from them."""

    def __init__(self, docs: DataFrame, least: int, longest: int, limit: int) -> None:
        self.spark, self.least, self.longest, self.limit = docs.sparkSession, least, longest, limit
        self.docs = docs.select(
            F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
        words = stored(phrase_counts(self.docs, 1), "words")
        self.totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        frequent = stored(words.filter(F.col("f") >= least), "words")
        self.pairs = stored(self._counted(2, every=(1, frequent)), "pairs")
        self.known = {1: frequent, 2: self.pairs}
        self.scored_pairs = stored(scored(_with_counts(self.pairs, 2, self.known), 2), "pairs")

    def _counted(self, n: int, every: tuple[int, DataFrame] | None = None, some: tuple[int, DataFrame] | None = None) -> DataFrame:
        tables = [t and (t[0], bit_table(self.spark, t[1])) for t in (every, some)]
        return phrase_counts(self.docs, n, *tables).filter(F.col("f") >= self.least)

    def round(self, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(settled survivors, all known candidates) of the languages of ``levels``.

        Every phrase whose bound reaches its language's level is grown by one word on both sides, words by words. Then
        all candidates at or above the level are known: a candidate's beginning has a bound no lower than its own
        score and a count no lower than its own. So are all candidates that contain one of them and one word more, which
        decide whether it is dropped: a longer one that does contains such a one that does.
        """
        counts, grown = dict(self.known), self.scored_pairs.join(levels, "lang")
        settled, known = [], []
        for n in range(2, self.longest + 1):
            if n > 2:
                frontier = grown.filter(_reached(F.col("bound"))).select("lang", "phrase")
                counts[n] = stored(self._counted(n, (2, self.pairs), (n - 1, frontier)), "grown")
                grown = stored(scored(_with_counts(counts[n], n, counts), n).join(levels, "lang"), "scored")
                grown = self._completed(grown, n, counts, levels)
            contest = grown.filter(_reached(F.col("cut")["score"]))
            known.append(grown.select("lang", "phrase", "f", F.col("cut")["score"].alias("score")))
            settled.append((n, contest.select("lang", "phrase", "f", "cut")))
        kept = None
        for n, contest in settled:
            if n < self.longest:
                contest = self._undropped(contest, n, counts[n + 1])
            kept = contest if kept is None else kept.unionByName(contest)
        everything = known[0]
        for more in known[1:]:
            everything = everything.unionByName(more)
        return stored(kept, "settled"), stored(everything, "known")

    def _completed(self, grown: DataFrame, n: int, counts: dict[int, DataFrame], levels: DataFrame) -> DataFrame:
        """``grown`` with the cuts that need a phrase no level has counted so far, for those that may reach theirs."""
        if n < 4:
            return grown
        for k in range(3, n):
            lacking = grown.filter(_reached(F.col("cut")["score"]))
            needed = None
            for name, part in ((f"b{k}", _part(1, k)), (f"e{k}", _part(n - k + 1, k))):
                own = lacking.filter(F.col(name).isNull()).select("lang", part.alias("phrase"))
                needed = own if needed is None else needed.union(own)
            needed = stored(needed.distinct(), "needed")
            if not needed.isEmpty():
                more = self._counted(k, (2, self.pairs), (k, needed)).join(counts[k], ["lang", "phrase"], "left_anti")
                counts[k] = stored(counts[k].unionByName(more), "grown")
        return stored(scored(_with_counts(counts[n], n, counts), n).join(levels, "lang"), "scored")

    @staticmethod
    def _undropped(contest: DataFrame, n: int, longer: DataFrame) -> DataFrame:
        """Without the phrases that lie in a phrase of one word more with at least 80 % of their count."""
        inside = longer.select("lang", _part(1, n).alias("phrase"), F.col("f").alias("_f")).union(
            longer.select("lang", _part(2, n).alias("phrase"), F.col("f").alias("_f"))
        ).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
        return contest.join(inside, ["lang", "phrase"], "left").filter(
            F.col("_f").isNull() | (_wide(F.col("_f")) * 100 < _wide(F.col("f")) * 80)).drop("_f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, limit: int = LIMIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``limit`` best phrases of 2 to ``longest`` words.

    ``docs`` (lang, text): A-Z are lower-cased, texts end pieces at ``. , ; : ! ?`` and line breaks, pieces are words
    between blanks and tabs. n counts a language's words, a the occurrences of a phrase inside pieces, overlaps included;
    a candidate has at least ``least``. Its score is that of its lowest cut into l and r occurrences, ties to the first.
    A candidate inside a longer one with at least 80 % of its occurrences is dropped. Order: score, a, then the phrase.

    Phrases grow best first. A level is set per language where twice the wanted number of known candidates lies above
    it, and all phrases whose bound reaches it are grown by counting over all texts (see ``Miner.round``). A language
    whose survivors at or above its level, ties included, are at least ``limit`` is settled; for the others the level
    is lowered to four times the number, until they settle or nothing is left to grow. Words and pairs of at least
    ``least`` occurrences are counted once; what counts as grown goes to the tasks as a table of at most 32 MB of bits.

    A null lang is ``und``; null, empty and blank texts have no words; repeated rows count each. Other columns are not
    read. An empty table gives an empty result, and a language without candidates no row.
    """
    miner = Miner(docs, least, longest, limit)
    rank = 2 * limit
    known = miner.scored_pairs.select("lang", "phrase", "f", F.col("cut")["score"].alias("score"))
    open_langs, done = known.select("lang").distinct(), None
    while True:
        levels = stored(_levels(known, open_langs, rank), "levels")
        survivors, known = miner.round(levels)
        counts = survivors.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
        state = stored(levels.join(counts, "lang", "left").select(
            "lang", ((F.coalesce("_n", F.lit(0)) >= limit) | (F.col("level")["f"] < 0)).alias("settled")), "state")
        ready = survivors.join(state.filter("settled").select("lang"), "lang", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        open_langs = state.filter("not settled").select("lang")
        if open_langs.isEmpty():
            break
        rank *= 4
    flat = done.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    top = _best(flat, limit, F.desc("score"), F.desc("a"), F.asc("phrase"))
    return top.join(miner.totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
