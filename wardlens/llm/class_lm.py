"""Brown's class-based bigram model: words are assigned to classes by exchange, texts are scored by class transitions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counter, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .store import stored

# A word takes part in the exchange's steps when it makes up at least one in so many training tokens, so there are at
# most so many; every other training word is put in the best class of the exchange's outcome.
LEXICON = 20_000
CLASSES = 64
PARTS = 4
# The exchange ends when a whole sweep over its words adds no more than this part to what the sweeps before it gained.
TOLERANCE = 0.05
# Documents whose words share one table in a task, and words after which such a block ends.
BLOCK_BITS, BLOCK_WORDS = 13, 4 << 20
SLICE = 256
# Pairs of words that a task lists anew before it sums them, besides as many as it has twice.
PAIRS = 500_000
# Count of the one word that stands for all unknown ones.
DELTA = 0.5
# Counts whose change of the likelihood is looked up, and words whose classes are compared at a time.
SMALL, CHUNK = 32, 1024


class _Blocks:
    """Walks over a task's batches in blocks of documents; each word of a block has a code.

    The given words have the first codes, in their order; a block's other words are numbered after them as they come,
    or share the code after them unless ``numbered``. A slice is coded when it is read, so a block holds its words' codes
    and each distinct word once, but no text. A block ends with its last place for a document or with ``BLOCK_WORDS``
    words, so long texts make short blocks.
    """

    def __init__(self, words: list[bytes], numbered: bool = True) -> None:
        self.words, self.numbered = words, numbered

    def walk(self, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
        """(block number, its words, list of (the slice's other columns, codes of its words in order, words per row))."""
        number, size, n_words, codes, held = 0, 0, 0, self._begun(), []
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, min(SLICE, (1 << BLOCK_BITS) - size, whole.num_rows - at))
                own, lengths = self._coded(batch.column(column), codes)
                rest = [c for k, c in enumerate(batch.columns) if k != column]
                # copied, as a batch of Spark's is one buffer that a slice of any column would keep whole
                held.append(([pc.take(c, pa.array(np.arange(len(batch)))) for c in rest], own, lengths))
                at, size, n_words = at + len(batch), size + len(batch), n_words + len(own)
                if size == 1 << BLOCK_BITS or n_words > BLOCK_WORDS:
                    words, codes = list(codes)[1:], None
                    yield number, words, held
                    number, size, n_words, codes, held = number + 1, 0, 0, self._begun(), []
            whole = batch = rest = None
        if held:
            words, codes = list(codes)[1:], None
            yield number, words, held

    def _begun(self) -> dict[bytes, int]:
        """Codes by word, in their order; white space at the ends of a text splits off an empty one, which comes first."""
        codes = {b"": -1, **{w: k for k, w in enumerate(self.words)}}
        return defaultdict(counter(len(self.words)).__next__, codes) if self.numbered else codes

    def _coded(self, texts: pa.Array, codes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """(codes, words per row); new words are added to ``codes`` if they are numbered."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        lengths = np.diff(lists.offsets.to_numpy())
        distinct = lists.flatten().dictionary_encode()
        found = distinct.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        known = map(codes.__getitem__, found) if self.numbered else map(codes.get, found, repeat(len(self.words)))
        own = np.fromiter(known, np.int32, len(found))[distinct.indices.to_numpy()]
        owners = np.repeat(np.arange(len(lengths)), lengths)[own >= 0]
        return own[own >= 0], np.bincount(owners, minlength=len(lengths))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words [^\\x20\\x09-\\x0D]+ of ``docs`` (text), A-Z lower-cased; words are bytes in UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table, parts in _Blocks([]).walk(batches, 0):
            totals = np.zeros(len(table), np.int64)
            for _, codes, _ in parts:
                totals += np.bincount(codes, minlength=len(table))
            if len(table):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table, pa.binary()), pa.array(totals, pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigrams(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(a, b, n): how often code b follows code a in ``docs``. Code len(words) is any other word, one more is the end.

    A text starts after an end and finishes with one.
    """
    rare = len(words)
    width = rare + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals, n_summed = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for _, _, parts in _Blocks(words, numbered=False).walk(batches, 0):
            for last, (_, codes, lengths) in enumerate(parts, 1 - len(parts)):
                line = _with_ends(codes, lengths, rare + 1)
                pairs, n = np.unique(line[:-1].astype(np.int64) * width + line[1:], return_counts=True)
                keys, totals = np.concatenate([keys, pairs]), np.concatenate([totals, n])
                if last == 0 or len(keys) > 2 * n_summed + PAIRS:
                    keys, place = np.unique(keys, return_inverse=True)
                    totals = np.bincount(place, weights=totals, minlength=len(keys)).astype(np.int64)
                    n_summed = len(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(totals)],
            ["a", "b", "n"])

    return docs.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _with_ends(codes: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """end, text, end, text, ..., end."""
    ends = np.cumsum(lengths)
    return np.concatenate([[end], np.insert(codes, ends, end)]).astype(np.int32)


def _entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(
    own: int, table: np.ndarray, out: np.ndarray, into: np.ndarray, self_n: float, classes: int
) -> tuple[int, float]:
    """(class, gain) of the best exchange of a word.

    ``table`` holds class transitions, ``out`` and ``into`` the word's transitions to and from every class, including
    ``self_n`` to itself. The gain is that of the training likelihood sum(n log n) - sum(row log row) - sum(col log col).
    """
    t = table.copy()
    t[own] -= out
    t[:, own] -= into
    t[own, own] += self_n  # counted in both
    o, i = out.copy(), into.copy()
    o[own] -= self_n
    i[own] -= self_n
    rows, cols = t.sum(axis=1) + i, t.sum(axis=0) + o  # wherever the word goes, the others' transitions stay
    n_out, n_in = out.sum(), into.sum()
    k = np.arange(classes)
    # row k gains o, column k gains i, the cell (k, k) gains both and the word's own pairs
    gain = (_entropy(t[k] + o) - _entropy(t[k])).sum(axis=1) + (_entropy(t[:, k] + i[:, None]) - _entropy(t[:, k])).sum(axis=0)
    cell = t[k, k]
    gain += _entropy(cell + o[k] + i[k] + self_n) - _entropy(cell + o[k]) - _entropy(cell + i[k]) + _entropy(cell)
    gain -= _entropy(rows[k] + n_out) - _entropy(rows[k]) + _entropy(cols[k] + n_in) - _entropy(cols[k])
    best = int(gain.argmax())
    return best, float(gain[best] - gain[own])


def exchange(
    table: DataFrame, n_words: int, classes: int = CLASSES, parts: int = PARTS, tolerance: float = TOLERANCE
) -> tuple[np.ndarray, np.ndarray]:
    """(class per code, class transitions) from the bigram table.

    Codes come in descending order of frequency and start in class code % classes; other words and the end have a class
    of their own each. In each step the words of one part are tried in parallel against the same state and those that
    gain move together; should that lower the likelihood, only the better half of them moves, and so on. Sweeps go on
    until one adds no more than ``tolerance`` to the gain of all. The table stays distributed, one row per word with its neighbours; the
    driver holds a class per lexicon word and the classes' transitions, both bounded by parameters.
    """
    width = classes + 2
    follow = table.groupBy(F.col("a").alias("w")).agg(
        F.collect_list("b").alias("next"), F.collect_list("n").alias("next_n"))
    lead = table.groupBy(F.col("b").alias("w")).agg(F.collect_list("a").alias("last"), F.collect_list("n").alias("last_n"))
    names = ["w", "next", "next_n", "last", "last_n"]

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists as bytes, which each step reads and hands over whole."""
        for batch in batches:
            lists = [_binaries(
                column.flatten().to_numpy().astype(t),
                pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64))
                for column, t in zip(batch.columns[1:], ("<i4", "<i8", "<i4", "<i8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names)

    lines = stored(follow.join(lead, "w", "full").select(*names).mapInArrow(
        compact, "w int, next binary, next_n binary, last binary, last_n binary"), "neighbours")
    state = np.concatenate([np.arange(n_words) % classes, [classes, classes + 1]]).astype(np.int64)

    def transitions(now: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width * width, np.int64)
            for batch in batches:
                ids, n = _flat(batch.column(1), "<i4"), _flat(batch.column(2), "<i8")
                sizes = pc.binary_length(batch.column(1)).to_numpy() // 4
                cells = np.repeat(now[batch.column(0).to_numpy()] * width, sizes) + now[ids]
                total += np.bincount(cells, n.astype(np.float64), len(total)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

        # one table of classes a task, so what comes back is bounded by parameters like the rows of ``lines``
        out = np.zeros(width * width, np.int64)
        for row in lines.select("w", "next", "next_n").mapInArrow(run, "counts binary").collect():
            out += np.frombuffer(row["counts"], np.int64)
        return out.reshape(width, width)

    def moves(now: np.ndarray, counts: np.ndarray, part: int) -> pd.DataFrame:
        counts = counts.astype(np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for w, *lists in zip(*batch.columns):
                    w, sides = w.as_py(), []
                    for other, amount in (lists[:2], lists[2:]):
                        ids = np.frombuffer(other.as_buffer(), "<i4")
                        size = np.frombuffer(amount.as_buffer(), "<i8").astype(np.float64)
                        sides.append((np.bincount(now[ids], size, width), float(size[ids == w].sum())))
                    target, gain = best_class(int(now[w]), counts, sides[0][0], sides[1][0], sides[0][1], classes)
                    if gain > 1e-6:
                        rows.append((w, target, gain))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[k] for row in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))],
                    ["w", "target", "gain"])

        return lines.filter((F.col("w") < n_words) & (F.col("w") % parts == part)).mapInArrow(
            run, "w int, target int, gain double").toPandas().sort_values(["gain", "w"], ascending=[False, True])

    def value(counts: np.ndarray) -> float:
        t = counts.astype(np.float64)
        return float(_entropy(t).sum() - _entropy(t.sum(axis=0)).sum() - _entropy(t.sum(axis=1)).sum())

    counts = transitions(state)
    if n_words == 0:
        return state, counts
    best = mark = start = value(counts)
    for step in counter():
        if step and step % parts == 0:
            if best - mark <= tolerance * (best - start):
                break
            mark = best
        found = moves(state, counts, step % parts)
        while len(found):
            trial = state.copy()
            trial[found["w"].to_numpy()] = found["target"].to_numpy()
            after = transitions(trial)
            if value(after) > best:
                state, counts, best = trial, after, value(after)
                break
            found = found.head(len(found) // 2)
    return state, counts


class FixedTable:
    """Class transitions against which words of the class ``classes`` are put in one of the classes before it."""

    def __init__(self, counts: np.ndarray, classes: int) -> None:
        self.t, self.classes = counts.astype(np.float64), classes
        step = np.arange(SMALL + 1)[:, None, None]
        self.known = []  # change of the likelihood by (count, other class), class
        for table in (self.t, self.t.T):
            change = (_entropy(table + step) - _entropy(table))[:, :classes].transpose(0, 2, 1)
            self.known.append(np.ascontiguousarray(change).reshape(-1, classes))

    def best(self, out: np.ndarray, into: np.ndarray, self_n: np.ndarray) -> np.ndarray:
        """The class of the highest likelihood for every word, as best_class has it for one.

        ``out`` and ``into`` are (words x width) without the pairs ``self_n`` of a word with itself. Only cells that a
        word's pairs touch are looked at.
        """
        t, classes, width = self.t, self.classes, len(self.t)
        k = np.arange(classes)
        cell, o, i, s = t[k, k], out[:, :classes], into[:, :classes], self_n[:, None]
        gain = _entropy(cell + o + i + s) - _entropy(cell + o) - _entropy(cell + i) + _entropy(cell)
        for side, other, table, known in ((out, into, t, self.known[0]), (into, out, t.T, self.known[1])):
            cells = side.copy()
            cells[:, classes] = 0
            w, j = np.nonzero(cells)
            n = cells[w, j].astype(np.int64)
            changes = known[np.minimum(n, SMALL) * width + j]
            large = np.flatnonzero(n > SMALL)
            column = table[:classes, j[large]].T
            changes[large] = _entropy(column + n[large, None]) - _entropy(column)
            if len(w):
                starts = np.flatnonzero(np.diff(w, prepend=-1))
                gain[w[starts]] += np.add.reduceat(changes, starts)
            left = table[:classes, classes] - other[:, :classes]  # the word's pairs with a class have left its old class
            gain += _entropy(left + side[:, classes, None]) - _entropy(left)
        for side, total in ((out, t.sum(axis=1)[k]), (into, t.sum(axis=0)[k])):
            gain -= _entropy(total + side.sum(axis=1)[:, None] + s) - _entropy(total)
        return gain.argmax(axis=1)


def word_classes(contexts: DataFrame, counts: np.ndarray, classes: int) -> DataFrame:
    """(word, n, class) of every word of ``contexts`` (word, before, after), each put in its best class of ``counts``.

    ``before`` and ``after`` hold the classes around a word's occurrences in one block, as pairs of a class and a number
    of times; len(counts) stands for the word itself. A word's rows lie behind each other and are summed as they come,
    so however frequent a word is, it takes two rows of counts. Each word is judged from its own sums against the fixed
    table, so the words stay distributed.
    """
    width = len(counts)
    kind = np.min_scalar_type(2 * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = FixedTable(counts, classes)
        last, carried = None, ()

        def judged(words: list[bytes], into: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
            best = fixed.best(out[:, :width], into[:, :width], out[:, width])
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(into.sum(axis=1).astype(np.int64)), pa.array(best.astype(np.int32))],
                ["word", "n", "class"])

        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                words = batch.column(0).to_numpy(zero_copy_only=False)
                starts = np.append(True, words[1:] != words[:-1])
                group = np.cumsum(starts) - 1
                into, out = (_pair_sums(batch.column(k), group, int(group[-1]) + 1, width + 1, kind) for k in (1, 2))
                if last == words[0]:
                    into[0] += carried[0][0]
                    out[0] += carried[1][0]
                elif last is not None:
                    yield judged([last], *carried)
                names = words[starts].tolist()
                if len(names) > 1:
                    yield judged(names[:-1], into[:-1], out[:-1])
                last, carried = names[-1], (into[-1:], out[-1:])
        if last is not None:
            yield judged([last], *carried)

    return contexts.repartition("word").sortWithinPartitions("word").select("word", "before", "after").mapInArrow(
        run, "word binary, n long, class int")


def _pairs(owner: np.ndarray, value: np.ndarray, n_owners: int, width: int, kind: np.dtype) -> pa.Array:
    """Per owner how often each value occurs, as pairs of value and number; a large number takes several pairs."""
    small = np.int32 if n_owners * width < 1 << 31 else np.int64
    key, times = np.unique(owner.astype(small) * small(width) + value.astype(small), return_counts=True)
    most = np.iinfo(kind).max
    parts = -(-times // most)
    key = np.repeat(key, parts)
    number = np.full(len(key), most, kind)
    number[np.cumsum(parts) - 1] = times - (parts - 1) * most
    flat = np.stack([(key % width).astype(kind), number], axis=1).ravel()
    return _binaries(flat, 2 * np.bincount(key // width, minlength=n_owners))


def _pair_sums(column: pa.Array, group: np.ndarray, n_groups: int, width: int, kind: np.dtype) -> np.ndarray:
    """The sums of ``_pairs`` over groups of rows: one row of ``width`` numbers a group."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = _flat(column, kind).reshape(-1, 2)
    owner = np.repeat(group, np.diff(ends) // (2 * np.dtype(kind).itemsize))
    return np.bincount(
        owner * width + flat[:, 0], flat[:, 1].astype(np.float64), n_groups * width).reshape(n_groups, width)


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all values of a column of bytes, without nulls, behind each other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)


def _binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``flat`` cut into one value of bytes per size."""
    offsets = np.concatenate([[0], np.cumsum(sizes * flat.itemsize)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def class_scores(
    docs: DataFrame, held_out: F.Column, lexicon: int = LEXICON, classes: int = CLASSES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Tokens are the words with A-Z lower-cased and one end per text. The model learns from rows that are not held out:
    P(token | before) = P(class | class before) * P(token | class). Class transitions are smoothed by the classes' own
    frequencies. Every training word has one of ``classes`` classes and its relative frequency there: words of the
    lexicon by exchange, every rarer one, however rare, by the best class for its own pairs given the outcome of the
    exchange. One word that stands for all unknown ones has a count of DELTA; what comes before and after it is learned
    from the words seen once. ``base_score`` is the add-one unigram score.

    A task lists, for a block of documents, each rare word once with its number in the block; the words' classes and
    counts are joined to them and return to the block, packed into one row per block and task. Only the lexicon (at most ``lexicon`` words) and class tables go
    to every task. Null and empty texts are the end alone. Rows with null ``held_out`` count as held out. Repeated rows
    are learned from and scored each. Without training rows all words are unknown, and an empty table gives an empty
    result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(held_out, F.lit(True)).alias("held_out"))
    training = rows.filter("not held_out")
    n_ends = training.count()
    vocabulary = stored(word_counts(training), "vocabulary")
    n_words, v_words = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, v_all = n_words + n_ends, v_words + (1 if n_ends else 0)
    frequent = vocabulary.filter(F.col("n") * lexicon >= n_all) if n_all else vocabulary.limit(0)
    common = sorted(((row["n"], bytes(row["word"])) for row in frequent.collect()), key=lambda x: (-x[0], x[1]))
    words, word_n = [w for _, w in common], np.asarray([n for n, _ in common], np.float64)
    rare, end = len(words), len(words) + 1
    state, counts = exchange(stored(bigrams(training, words), "bigrams"), len(words), classes)

    width, unknown, last = classes + 2, classes, classes + 1
    kind = np.min_scalar_type(2 * width)  # words seen once have their class plus width
    unit = n_all + v_all + 1
    base, own = np.zeros(end + 1), np.zeros(end + 1)
    base[: rare], own[: rare] = np.log10((word_n + 1) / unit), np.log10(word_n)
    base[end] = np.log10((n_ends + 1) / unit)
    schema = "word binary, block long, place int, before binary, after binary, doc_id long, held_out boolean, " \
        "n_known long, base double, own double, line binary"
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(),
             pa.float64(), pa.float64(), pa.binary()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, table, parts in _Blocks(words).walk(batches, 1):
            block = (task << 20) + number
            found, befores, afters = [], [], []
            for (doc_ids, held), codes, lengths in parts:
                size = len(lengths)
                short = np.minimum(codes, rare)
                owners = np.repeat(np.arange(size), lengths)
                # a lexicon word is its class, a rare one width plus its number in the block
                line = np.where(codes < rare, state[short], codes - rare + width).astype(np.int32)
                known = np.bincount(owners, codes < rare, size) + (n_ends > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(size, kinds[0]), pa.array(np.full(size, block)), *(pa.nulls(size, k) for k in kinds[2:5]),
                     doc_ids, held, pa.array(known.astype(np.int64)),
                     pa.array(np.bincount(owners, base[short], size) + base[end]),
                     pa.array(np.bincount(owners, own[short], size)), _binaries(line, lengths)], names)
                whole = _with_ends(codes, lengths, -1)
                at = np.flatnonzero((whole >= rare) & np.concatenate([[False], np.repeat(
                    ~held.to_numpy(zero_copy_only=False), lengths + 1)]))
                around = np.where(whole < 0, last, state[np.clip(whole, 0, rare)])
                found.append(whole[at] - rare)
                for side, other in ((befores, at - 1), (afters, at + 1)):
                    side.append(np.where(whole[other] == whole[at], width, around[other]).astype(kind))
            codes, listed = np.concatenate(found), table[rare:]
            before, after = (_pairs(codes, np.concatenate(x), len(listed), width + 1, kind) for x in (befores, afters))
            for a in range(0, len(listed), 20_000):
                b = min(a + 20_000, len(listed))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(listed[a:b], pa.binary()), pa.array(np.full(b - a, block)),
                     pa.array(np.arange(a, b, dtype=np.int32)), before.slice(a, b - a), after.slice(a, b - a),
                     *(pa.nulls(b - a, k) for k in kinds[5:])], names)

    passed = stored(rows.mapInArrow(encode, schema), "encoded")
    listed = passed.filter("word is not null")
    # a block lists words of held-out rows too; those without training occurrences have no class
    classed = stored(word_classes(
        listed.filter(F.length("before") > 0).select("word", "before", "after"), counts, classes), "word_classes")
    n_class = np.bincount(state[: rare], word_n, width)
    for row in classed.groupBy("class").agg(F.sum("n").alias("n")).collect():
        n_class[row["class"]] += row["n"]
    n_class[last] = n_ends

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of a block that meet in a task, as one row: places, classes and counts side by side."""
        held: list[np.ndarray] = []

        def rows_of() -> pa.RecordBatch:
            all_ = np.concatenate(held, axis=1)
            all_ = all_[:, np.argsort(all_[0], kind="stable")]
            blocks, sizes = np.unique(all_[0], return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks), *(_binaries(all_[k].astype(t), sizes) for k, t in ((1, "<i4"), (2, kind), (3, "<i8")))],
                ["block", "places", "kinds", "times"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            if sum(x.shape[1] for x in held) > 1 << 20:
                yield rows_of()
                held = []
        if held:
            yield rows_of()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, of, n = None, None, None
        for whole in batches:
            blocks = whole.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if current != int(blocks[a]):
                    current, of, n = int(blocks[a]), np.full(0, unknown), np.zeros(0)
                batch = whole.slice(a, b - a)
                is_word = batch.column(4).to_numpy(zero_copy_only=False)
                for row in np.flatnonzero(is_word):
                    place, kept, times = (
                        np.frombuffer(batch.column(k)[int(row)].as_py(), t).astype(np.int64)
                        for k, t in ((1, "<i4"), (2, kind), (3, "<i8")))
                    grow = int(place.max()) + 1 - len(of)
                    if grow > 0:
                        of = np.concatenate([of, np.full(max(grow, len(of)), unknown)])
                        n = np.concatenate([n, np.zeros(max(grow, len(n)))])
                    of[place], n[place] = kept + width * (times == 1), times
                lines = batch.filter(pa.array(~is_word))
                for start in range(0, lines.num_rows, SLICE):
                    part = lines.slice(start, SLICE)
                    texts = part.column(10).to_pylist()
                    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) // 4
                    line = np.frombuffer(b"".join(texts), "<i4").astype(np.int64)
                    owners = np.repeat(np.arange(len(lengths)), lengths)
                    at = np.flatnonzero(line >= width)
                    place = line[at] - width
                    fits = place < len(of)
                    place = place[fits]
                    times = np.zeros(len(at))
                    line[at] = unknown
                    line[at[fits]], times[fits] = of[place], n[place]
                    sums = [np.bincount(owners[at], x, len(lengths)) for x in (
                        times > 0, np.log10((times + 1) / unit), np.log10(np.maximum(times, 1)))]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(5), part.column(6), pa.array(lengths.astype(np.int64) + 1),
                         pa.array(part.column(7).to_numpy() + sums[0].astype(np.int64)),
                         pa.array(part.column(8).to_numpy() + sums[1]), pa.array(part.column(9).to_numpy() + sums[2]),
                         _binaries(line.astype(kind), lengths)],
                        ["doc_id", "held_out", "n_tokens", "n_known", "base", "own", "line"])

    none = [F.lit(None).cast(t).alias(c) for c, t in (
        ("doc_id", "long"), ("held_out", "boolean"), ("n_known", "long"), ("base", "double"), ("own", "double"),
        ("line", "binary"))]
    met = listed.select("word", "block", "place").join(classed, "word").select("block", "place", "class", "n").mapInArrow(
        packed, "block long, places binary, kinds binary, times binary").select("*", F.lit(True).alias("is_word"), *none)
    nothing = F.lit(None).cast("binary")
    texts = passed.filter("word is null").select(
        "block", nothing.alias("places"), nothing.alias("kinds"), nothing.alias("times"), F.lit(False).alias("is_word"),
        "doc_id", "held_out", "n_known", "base", "own", "line")
    # a block is whole in one task, its words before its documents
    settled = stored(
        met.union(texts).repartition("block").sortWithinPartitions("block", F.col("is_word").desc())
        .mapInArrow(settle, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, line binary"),
        "settled")

    def ended(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = column.to_pylist()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) // kind.itemsize
        return _with_ends(np.frombuffer(b"".join(texts), kind), lengths, last), lengths

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * width * width, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                line, _ = ended(whole.slice(start, SLICE).column(0))
                total += np.bincount(line[:-1].astype(np.int64) * (2 * width) + line[1:], minlength=len(total))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["pair", "n"])

    full = np.zeros(4 * width * width)
    for row in settled.filter("not held_out").select("line").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(
            F.sum("n").alias("n")).collect():
        full[row["pair"]] = row["n"]
    step = transition_scores(full.reshape(2, width, 2, width), n_class, unknown)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                line, lengths = ended(batch.column(6))
                line %= width
                sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths + 1), step[line[:-1], line[1:]], len(lengths))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array(np.full(len(lengths), n_all, np.int64)), batch.column(4),
                     pa.array(batch.column(5).to_numpy() + sums)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return settled.mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def transition_scores(full: np.ndarray, n_class: np.ndarray, unknown: int) -> np.ndarray:
    """log10 of P(class | class before) over the class's count, so that adding log10 of a word's count gives the score.

    ``full`` holds the training pairs of (seen once, class, seen once, class). After each class the unknown word has a
    probability of DELTA over all tokens, raised or lowered as words seen once are frequent there; what follows it is
    what follows words seen once.
    """
    width = len(n_class)
    counts, after, before = full.sum(axis=(0, 2)), full[1].sum(axis=(0, 1)), full[:, :, 1].sum(axis=(0, 2))
    real = np.arange(width) != unknown
    strength, n_all, n_once = float(width - 2), n_class.sum(), full[1].sum()
    prior = np.where(real, n_class + 1.0, 0)
    prior /= prior.sum()
    rows = counts.sum(axis=1)
    p = (counts + strength * prior) / (rows[:, None] + strength)
    p[unknown] = (after + strength * prior) / (n_once + strength)
    u = np.full(width, DELTA / (n_all + 1))
    if n_once:
        share = n_once / n_all
        u *= np.where(real, (before + strength * share) / (rows + strength) / share, 1)
    p *= (1 - u)[:, None]
    p[:, unknown] = u
    ends = np.arange(width) == width - 1  # the end is the one word of its class
    return np.log10(p / np.where(real & ~ends, np.maximum(n_class, 1), 1))
