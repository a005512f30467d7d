"""Archives, page texts, token counts, token files and packing against plain recomputation."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from base64 import b32encode
from hashlib import sha1
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from wardlens.llm import (
    circulant, queries, token_files, tokens, trie_counts, vector_fit, warc, words, wrappers, zip_archive,
)
from wardlens.llm.tokens import Encoder, encoder, uneven
from wardlens.session import scratch_path

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello, world! It's 12.5", "", None, " lead", "tail ", "a  b\n\nc\t d\r\ne", "<|endoftext|> x", "nb sp  x",
         "Été é ΣαΣ", "x" * 3000, "word " * 6000, "\x1c!!\x1c!!", "İx 日本語", "?", "\n"]


def test_zip_members_agree_with_the_standard_module():
    sink = io.BytesIO()
    package = zip_archive.Writer(sink)
    for name, data in (("archive/a", b"x" * 1000), ("indexes/b", b""), ("archive/é", b"yz")):
        package.start(name), package.append(data), package.finish()
    package.close()
    whole = sink.getvalue()
    found = zip_archive.members(io.BytesIO(whole), len(whole))
    with zipfile.ZipFile(io.BytesIO(whole)) as plain:
        assert plain.testzip() is None
        for m in found:
            assert whole[m.offset : m.offset + m.size] == plain.read(m.name)
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as plain:
        plain.writestr("archive/c", b"abc")
        plain.comment = b"a comment"
    data = other.getvalue()
    (m,) = zip_archive.members(io.BytesIO(data), len(data))
    assert data[m.offset : m.offset + m.size] == b"abc"
    with pytest.raises(ValueError):
        zip_archive.members(io.BytesIO(data[:-40]), len(data) - 40)


def test_warc_round_trip(spark):
    pages = [(k, f"http://h/{k}", "<p>same</p>", 1) for k in range(40)]
    pages += [(50, None, None, 1), (51, "http://h/\n<x>", "", 1), (52, "u", "é" * 200_000, 1), (52, "u", "é" * 200_000, 1)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, response int").repartition(3)
    packages = warc.write_archives(frame, scratch_path(spark, "warc"))
    found = warc.read_records(spark, packages, range_bytes=2000).collect()
    assert len(found) == len(pages)
    for r in found:
        page = int(r.record_id[10:-1])
        payload = ("<p>same</p>" if page < 50 else "é" * 200_000 if page == 52 else "").encode()
        response = 39 if page < 50 else 52 if page == 52 else 51
        assert (r.payload_bytes, r.payload_digest) == (len(payload), b32encode(sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (
            ("response", None) if page == response else ("revisit", f"<urn:page:{response}>"))
        assert r.payload is None if page != response else bytes(r.payload) == payload
    empty = warc.write_archives(frame.limit(0), scratch_path(spark, "warc"))
    assert warc.read_records(spark, empty).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li>a<li>b</ul>
</nav><div id="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1><p>By X</p></header>%s<div class="share">S</div>
<form>f</form></article><aside>side</aside><section class="comments"><p>nice</p></section><footer>f</footer></body></html>"""


def test_wrappers_extract_articles(spark):
    bodies = ["<p>One <b>t</b>wo<br>three</p>", "<p>x<p>y\n z", "<h2>s</h2><ul><li>1<li>2</ul><script>var a='<p>no</p>'</script>", ""]
    texts = ["Head & line\nOne two three", "Head & line\nx\ny z", "Head & line\ns\n1\n2", "Head & line"]
    rows = [(k, f"https://H.example/{k}", PAGE % bodies[k % 4], "x") for k in range(60)]
    rows += [(60, None, None, "x"), (61, "", "", "x"), (62, "u", "<p>just &lt;text", "x"), (63, "u", "<script>1</script>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(5)
    found = {r.page_id: r for r in wrappers.extract(frame, fan_in=2).collect()}
    for k in range(60):
        assert found[k].text == texts[k % 4] and found[k].n_chars == len(found[k].text)
    assert [found[k].text for k in range(60, 64)] == ["", "", "just <text", ""]
    assert wrappers.extract(frame.limit(0)).collect() == []


@pytest.mark.parametrize("names", ["page has-sidebar", "no-sidebar", "comments-open", "layout widget"])
def test_containers_named_like_furniture_keep_their_article(spark, names):
    page = """<body><div class="top">Site</div><div class="%s"><article><h1>Head</h1><p>Body %d</p></article>
    <div class="comments"><article class="comment"><p>%s</p></article></div><div class="sidebar">side</div></div></body>"""
    plain = """<body><p>Top</p><div class="%s"><div class="text"><p>The text of page %d is here.</p></div>
    <div class="share">Share</div></div></body>"""
    bare = """<body><div class="text"><p>The long text of page %d is here.</p></div><div class="related"><p>Other</p></div></body>"""
    rows = [(k, f"http://a/{k}", page % (names, k, "nice " * k)) for k in range(6)]
    rows += [(10 + k, f"http://b/{k}", plain % (names, k)) for k in range(6)]
    rows += [(20 + k, f"http://c/{k}", bare % k) for k in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in wrappers.extract(frame).collect()}
    assert [found[k] for k in range(6)] == [f"Head\nBody {k}" for k in range(6)]
    assert [found[10 + k] for k in range(6)] == [f"The text of page {k} is here." for k in range(6)]
    assert [found[20 + k] for k in range(6)] == [f"The long text of page {k} is here." for k in range(6)]


def test_alignment_makes_optional_and_repeated_groups():
    def wrapper(html):
        return wrappers.skeleton(wrappers.tree(html))

    one = wrapper("<div><h2>a</h2><p>b</p></div>")
    two = wrapper("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p></div>")
    assert wrappers.expression(two) == "<div>(<h2>#</h2>(<p>#</p>)+)+</div>"
    assert wrappers.expression(wrappers.align(one, two)) == "<div>(<h2>#</h2>(<p>#</p>)+)+</div>"
    three = wrapper("<div><h2>a</h2><ul><li>x</ul><p>b</p></div>")
    assert wrappers.expression(wrappers.align(one, three)) == "<div><h2>#</h2>(<ul><li>#</li></ul>)?<p>#</p></div>"


def test_trie_counts_agree_with_the_library(spark):
    from tokenizers import Tokenizer, models

    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = trie_counts.zipf_scores(path)
    model = Tokenizer(models.Unigram([("<unk>", min(scores.values()) - 10), *scores.items()], unk_id=0, byte_fallback=False))
    words = "the then there été ☃ abcabcabc internationalisation x ☃☃".split()
    trie = trie_counts.Trie(scores)
    for word in words:
        assert trie.terminal(trie_counts.MARK + word)[1] - max(0, trie.terminal(trie_counts.MARK + word)[2] - 1) == len(
            model.encode(trie_counts.MARK + word).ids)
    long = "ab" * 500
    assert trie.terminal(long) == trie._alone(long)
    rows = [(1, " ".join(words), 0), (2, None, 0), (3, "", 0), (3, "the\nthe", 0), (4, long * 20, 0)]
    found = trie_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, score int"), path).collect()
    assert {(r.doc_id, r.n_pretokens) for r in found} == {(1, len(words)), (2, 0), (3, 0), (3, 2), (4, 1)}
    assert sum(r.n_tokens for r in found if r.doc_id == 1) == sum(trie.terminal(trie_counts.MARK + w)[1] for w in words)


@pytest.mark.parametrize("path, spaced", [(WORDS, False), (BYTES, True)])
def test_pieces_encode_like_whole_texts(path, spaced):
    codec, fresh = encoder(path, spaced), Tokenizer.from_file(path)
    special = ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b\n c", "<|EndOfText|> <|endoftext", "x " * 500 + "<|endoftext|>"]
    for text in TEXTS + special:
        ids = fresh.encode(text or "", add_special_tokens=False).ids
        assert codec.encode(text) == np.asarray(ids, "<u4").tobytes(), text


def test_words_of_letters_are_one_pre_token_without_a_pattern():
    codec, fresh = Encoder(BYTES, True), Tokenizer.from_file(BYTES)
    assert codec.memo["\n"] and codec.parts.pop("\n")  # what lines are joined by
    codec.ascii_pre_tokens = codec.pre_tokens = None  # a call would fail
    for text in ("Plain words on a line", "été Straße œuvre", "a", "ab"):
        assert codec.encode(text) == np.asarray(fresh.encode(text).ids, "<u4").tobytes()
    assert not codec.parts


def test_uneven_texts_are_found():
    for size in range(1, 5):
        for text in map("".join, product("a \n\t\r", repeat=size)):
            assert uneven(text) == bool(re.search(r"[ \n][ \n]|[\t\r]|\A[ \n]|[ \n]\Z", text)), repr(text)


def test_files_are_ordered_by_number(spark, tmp_path):
    for number, ids in ((99_999, [1, 2]), (100_000, [3]), (100_001, [4, 5, 6])):
        source = str(tmp_path / f"one-{number}")
        spark.createDataFrame([(number, len(ids), ids)], token_files.SCHEMA).coalesce(1).write.parquet(source)
        (tmp_path / "all").mkdir(exist_ok=True)
        (only,) = (tmp_path / f"one-{number}").glob("part-*.parquet")
        only.rename(tmp_path / "all" / f"part-{number}-x.parquet")
    found = token_files.token_ranges(token_files.read_tokens(spark, str(tmp_path / "all"))).collect()
    assert {r.doc_id: r.start for r in found} == {99_999: 0, 100_000: 2, 100_001: 3}


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files_round_trip(spark, encoding):
    rows = [(7 * k % 15, t, "x") for k, t in enumerate(TEXTS)] + [(3, "again", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tokens string").repartition(4)
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(frame, path, WORDS, 2, encoding=encoding)
    stored = token_files.read_tokens(spark, path)
    codec = encoder(WORDS, False)
    expected = sorted((i, codec.encode(t) + np.asarray([2], "<u4").tobytes()) for i, t, _ in rows)
    found = sorted(token_files.token_ranges(stored).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [i for i, _ in expected]
    assert sorted((r.doc_id, r.ids_crc32) for r in found) == sorted((i, zlib.crc32(b)) for i, b in expected)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    plan = stored.filter("doc_id = 3").select("n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "PushedFilters: [IsNotNull(doc_id)" in plan
    token_files.write_tokens(frame.limit(0), path + "-none", WORDS, 2)
    assert token_files.token_ranges(token_files.read_tokens(spark, path + "-none")).collect() == []


def test_packing_keeps_every_piece(spark):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)] + [(100 + k, "w " * (k * 37 % 900), 1) for k in range(120)] + [(3, "again", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(3)
    found = vector_fit.packed_documents(frame, BYTES, 0, 512).collect()
    codec = encoder(BYTES, True)
    sizes = {}
    for r in found:
        sizes.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sizes.values():
        places.sort()
        assert sum(n for _, n in places) <= 512
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
    total = sum(len(codec.encode(t)) // 4 + 1 for _, t, _ in rows)
    assert sum(r.length for r in found) == total and len(sizes) <= -(-total // 512) + 2
    assert all(r.length == 512 for r in found if r.piece > 0)
    assert vector_fit.packed_documents(frame.limit(0), BYTES, 0).collect() == []


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_every_capacity_holds(spark, rule):
    pieces = spark.createDataFrame([(k, 0, 1 + k * 7 % 60) for k in range(300)], "doc_id long, piece int, length long")
    found = vector_fit.packed(pieces, 100, max_documents=3, max_attention=4000, rule=rule, group=64).collect()
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert len(found) == 300
    assert all(sum(b) <= 100 and len(b) <= 3 and sum(x * x for x in b) <= 4000 for b in bins.values())


def test_ids_travel_in_16_bits_and_come_back_in_32(spark):
    wide, small = np.arange(65_530, 65_540, dtype="<u4").tobytes(), np.arange(9, dtype="<u4").tobytes()
    assert vector_fit.narrowed(wide) == wide and len(vector_fit.narrowed(small)) == len(small) // 2
    frame = spark.createDataFrame([(1, "one two three " * 400), (2, None), (2, "ünï 文字 🙂")], "doc_id long, text string")
    kept = vector_fit.pieces_of(frame, BYTES, 0, 512, narrow=True).collect()
    assert kept and all(len(r.ids) == 2 * r.length for r in kept)
    for r in vector_fit.packed_documents(frame, BYTES, 0, 512, with_ids=True).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]


def test_workers_hold_few_words_between_tasks(spark):
    word = "concat('w', lower(hex(id * 60 + i)))"
    frame = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", f"concat_ws(' ', transform(sequence(0, 59), i -> {word})) as text")
    circulant.signatures(frame, 2).write.format("noop").mode("overwrite").save()
    before = [r.ids for r in vector_fit.pieces_of(frame, BYTES, 0).collect()]

    def held(batches):
        for batch in batches:
            memos = [m for e in tokens._encoders.values() for m in (e.memo, e.after_space, e.parts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([max([0, *(len(m) + len(m.older) for m in memos)])]), pa.array([len(words._memo)])], ["pieces", "words"])

    found = spark.range(0, 8, 1, 8).mapInArrow(held, "pieces long, words long").collect()
    assert 0 < max(r.pieces for r in found) <= 100_000 and {r.words for r in found} == {0}
    assert [r.ids for r in vector_fit.pieces_of(frame, BYTES, 0).collect()] == before
