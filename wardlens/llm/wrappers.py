"""Main text of web pages by wrappers that are inferred per host as union-free regular expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import stored

# Streams that one merging task aligns; a host's streams meet in rounds of so many.
FAN_IN = 64

# Elements that start or end a block, elements whose content is no prose, and elements of page furniture.
BLOCKS = frozenset(
    "html head body title main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address header footer nav aside form fieldset details summary hr".split())
RAW = frozenset("script style textarea xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "head script style textarea xmp iframe noembed noframes noscript template svg math canvas object audio video map nav "
    "aside footer form fieldset select option button label dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id or role that mark furniture, and words that mark the main part.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside complementary widget widgets related recommended recommendations share sharing "
    "social comment comments commentlist respond reply replies discussion disqus footer contentinfo masthead topbar "
    "toolbar pagination pager search searchbox form dialog".split())
MAIN = frozenset("content article post entry story main".split())
# Words that mark an article element as a reader's words.
COMMENT = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
# Elements nested deeper than this count as children of the element at this depth, as browsers have it.
DEPTH = 120

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
# A start tag ends an open element of the same line of this table.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}


def _label(tag: str, attributes: str) -> str:
    """The tag with its first class or id words; "!" marks an element whose whole content is furniture.

    "?" marks one that only its class, id or role calls furniture: what it holds decides.
    """
    if not attributes or attributes.isspace():
        return "!" + tag if tag in DROPPED else tag
    words: list[str] = []
    drop, named = tag in DROPPED, False
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            drop = True
        elif name == "style":
            drop = drop or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
        else:
            words += _WORD.findall(value)
    if tag == "article":
        named = not COMMENT.isdisjoint(words) and MAIN.isdisjoint(words)
    elif tag not in ("html", "body", "main"):
        named = not FURNITURE.isdisjoint(words)
    mark = "!" if drop else "?" if named else ""
    return mark + ".".join([tag, *words[:2]])


class _Below:
    """The open elements below ``DEPTH``, of which only their tags and whether they are furniture matter."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.closed: list[bool] = []
        self.count: dict[str, int] = {}

    def open(self, tag: str, furniture: bool) -> None:
        self.tags.append(tag)
        self.closed.append(furniture or bool(self.closed) and self.closed[-1])
        self.count[tag] = self.count.get(tag, 0) + 1

    def leave(self, tag: str) -> bool:
        """Close the innermost element of that tag, if one is open here."""
        if not self.count.get(tag):
            return False
        while True:
            last = self.tags.pop()
            self.closed.pop()
            self.count[last] -= 1
            if last == tag:
                return True

    def clear(self) -> None:
        self.tags, self.closed, self.count = [], [], {}

    @property
    def furniture(self) -> bool:
        return bool(self.closed) and self.closed[-1]


def tree(html: str) -> list:
    """The page as nested [label, text, children]; texts of a block come decoded, one entry ["#", text, links] each.

    Inline tags leave no trace, a line break is white space; what an inline element holds that is hidden or that its
    class, id or role calls furniture is left out. Comments, declarations, scripts and styles hold no text. End tags
    without a start are ignored, and what stays open ends with the page.
    """
    root: list = ["", None, []]
    stack, names, below = [root], [""], _Below()
    held: list[str] = []
    linked = 0
    anchor = False
    hidden: tuple[str, int, int] | None = None  # an inline element left out: tag, how many are open, depth around it
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            stack[-1][2].append(["#", text, min(linked, len(text))])
        held.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal hidden
        del stack[depth:], names[depth:]
        below.clear()
        if hidden and depth <= hidden[2]:
            hidden = None

    def add(text: str) -> None:
        nonlocal linked
        if hidden or below.furniture:
            return
        text = unescape(text)
        held.append(text)
        if anchor:
            linked += len(text.strip())

    for match in _TOKEN.finditer(html):
        if match.start() < at:
            continue
        if match.start() > at:
            add(html[at : match.start()])
        at = match.end()
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCKS or tag in DROPPED
        if closing:
            if hidden and tag == hidden[0]:
                hidden = (tag, hidden[1] - 1, hidden[2]) if hidden[1] > 1 else None
            if tag == "a":
                anchor = False
            elif block:
                if below.count.get(tag):
                    flush()
                    below.leave(tag)
                elif tag in names:
                    flush()
                    leave(len(names) - 1 - names[::-1].index(tag))
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = stop.start() if stop else end
            continue
        if tag == "br":
            held.append(" ")
        elif tag not in VOID and block:
            flush()
            if below.tags:
                # as above: a paragraph ends where a block starts, an item where its sibling does
                while below.tags and (below.tags[-1] == "p" and tag in BLOCKS or below.tags[-1] in _ENDS.get(tag, ())):
                    below.leave(below.tags[-1])
            if not below.tags:
                if names[-1] == "p" and tag in BLOCKS:
                    leave(len(names) - 1)
                ends = _ENDS.get(tag)
                while ends and names[-1] in ends:
                    leave(len(names) - 1)
            label = _label(tag, attributes)
            if below.tags or len(stack) > DEPTH:
                below.open(tag, label[0] in "!?")
            else:
                node = [label, None, []]
                stack[-1][2].append(node)
                stack.append(node)
                names.append(tag)
        elif tag in VOID:
            if block:
                flush()
                if names[-1] == "p" and not below.tags:
                    leave(len(names) - 1)
        else:
            if tag == "a":
                anchor = True
            if hidden:
                if tag == hidden[0]:
                    hidden = (tag, hidden[1] + 1, hidden[2])
            elif not attributes.endswith("/") and attributes and _label(tag, attributes)[0] in "!?":
                hidden = (tag, 1, len(stack) - 1)
    if at < end:
        add(html[at:end])
    flush()
    _decide(root)
    return root[2]


def _kept(node: list) -> tuple[int, bool]:
    """(characters outside links, is there an article, main or content-named element) in the open part."""
    chars, found = 0, False
    for child in node[2]:
        if child[0] == "#":
            chars += len(child[1]) - child[2]
        elif child[0][0] not in "!?":
            n, inside = _kept(child)
            tag, *words = child[0].split(".")
            chars, found = chars + n, found or inside or n > 0 and (
                tag in ("article", "main") or not MAIN.isdisjoint(words))
    return chars, found


def _questioned(node: list) -> Iterator[list]:
    """The outermost elements below a node that wait for a decision."""
    for child in node[2]:
        if child[0][0] == "?":
            yield child
        elif child[0] != "#" and child[0][0] != "!":
            yield from _questioned(child)


def _inner(node: list) -> tuple[int, bool]:
    """(characters outside links, is there an article or main) with all that waits for a decision."""
    chars, tagged = 0, False
    for child in node[2]:
        if child[0] == "#":
            chars += len(child[1]) - child[2]
        elif child[0][0] != "!":
            n, t = _inner(child)
            chars, tagged = chars + n, tagged or t or n > 0 and child[0].split(".")[0] in ("article", "main")
    return chars, tagged


def _decide(root: list) -> None:
    """Turn every "?" into furniture or not.

    While the open part of a page has no article, main or content-named element, the element that holds an article or
    main, or else more prose outside links than is open, loses its mark: the one with most prose first. Furniture inside
    it is judged anew, so a layout container opens and the comments beside the article stay closed.
    """
    while waiting := list(_questioned(root)):
        chars, found = _kept(root)
        fit = [(tagged, n, x) for x in waiting for n, tagged in [_inner(x)] if tagged or n > chars]
        if found or not fit:
            break
        best = max(fit, key=lambda x: x[:2])[2]
        best[0] = best[0][1:]
    for node in waiting:
        node[0] = "!" + node[0][1:]


def skeleton(nodes: list) -> list:
    """A page's stream as a regular expression: items [label, optional, repeated, children], "#" for a text slot."""
    return fold([
        ["#", False, False, []] if n[0] == "#" else [n[0], False, False, [] if n[0][0] == "!" else skeleton(n[2])]
        for n in nodes])


def _same(a: list, b: list) -> bool:
    return a[0] == b[0]


def fold(items: list) -> list:
    """Fold runs of one item, then of groups of two to four, into repeated ones; their differences become optional."""
    out: list = []
    for item in items:
        if out and _same(out[-1], item):
            out[-1] = [item[0], out[-1][1] and item[1], True, align(out[-1][3], item[3])]
        else:
            out.append(item)
    for width in (2, 3, 4):
        k = 0
        while k + 2 * width <= len(out):
            first, second = out[k : k + width], out[k + width : k + 2 * width]
            if all(map(_same, first, second)) and not any(x[0].startswith("(") for x in first):
                inner = [_merged(x, y) for x, y in zip(first, second)]
                out[k : k + 2 * width] = [_group(inner)]
                while out[k + 1 : k + 1 + width] and len(out) >= k + 1 + width and all(
                        map(_same, inner, out[k + 1 : k + 1 + width])):
                    inner = [_merged(x, y) for x, y in zip(inner, out[k + 1 : k + 1 + width])]
                    out[k : k + 1 + width] = [_group(inner)]
            k += 1
    return out


def _group(inner: list) -> list:
    return ["(" + " ".join(x[0] for x in inner) + ")", False, True, inner]


def _merged(a: list, b: list) -> list:
    children = [_merged(x, y) for x, y in zip(a[3], b[3])] if a[0].startswith("(") else align(a[3], b[3])
    return [a[0], a[1] or b[1], a[2] or b[2], children]


def _grouped(items: list, other: list) -> list:
    """``items`` with each run that the other side knows as a repeated group wrapped as that group."""
    for group in [x for x in other if x[0].startswith("(")]:
        labels, k, out = [x[0] for x in group[3]], 0, []
        while k < len(items):
            if [x[0] for x in items[k : k + len(labels)]] == labels:
                out.append(_group(items[k : k + len(labels)]))
                k += len(labels)
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in order.

    One row of the usual table is one number whose bits are the columns where the length does not grow, so thousands of
    siblings are a few thousand additions.
    """
    where: dict[str, int] = {}
    for j, label in enumerate(b):
        where[label] = where.get(label, 0) | 1 << j
    row = whole = (1 << len(b)) - 1
    rows = []
    for label in a:
        met = row & where.get(label, 0)
        row = (row + met | row - met) & whole
        rows.append(row)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> j - 1 & 1:
            j -= 1
            pairs.append((i, j))
    return pairs[::-1]


def align(a: list, b: list) -> list:
    """One expression that covers both: common items in order, merged; an item that only one has becomes optional."""
    if a == b:
        return a
    a, b = _grouped(a, b), _grouped(b, a)
    out, i, j = [], 0, 0
    for x, y in [*common([item[0] for item in a], [item[0] for item in b]), (len(a), len(b))]:
        out += [[item[0], True, *item[2:]] for item in [*a[i:x], *b[j:y]]]
        if x < len(a):
            out.append(_merged(a[x], b[y]))
        i, j = x + 1, y + 1
    return fold(out)


def expression(items: list) -> str:
    """The wrapper in the usual notation, e.g. <html><p>#</p>+</html>."""
    out = []
    for label, optional, repeated, children in items:
        inner = expression(children)
        if label.startswith("("):
            text = f"({inner})"
        else:
            text = "#" if label == "#" else f"<{label}>{inner}</{label}>"
            text = f"({text})" if optional or repeated else text
        out.append(text + {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[
            optional, repeated])
    return "".join(out)


def _paths(items: list, above: str = "") -> Iterator[str]:
    """Every element path of a wrapper; groups leave no step."""
    for label, _, _, children in items:
        if label.startswith("("):
            yield from _paths(children, above)
        elif label != "#" and label[0] != "!":
            yield f"{above}/{label}"
            yield from _paths(children, f"{above}/{label}")


def main_paths(wrapper: list, prose: dict[str, int]) -> list[str]:
    """The outermost paths of the wrapper that hold the main text.

    Article elements are asked first, then main elements, then elements whose class or id names content: the first kind
    that holds at least half as much prose outside links as any of the others, so neither a teaser nor a comment stands
    for the text around it. Without any it is the deepest element that holds two thirds of the host's prose.
    """
    paths = sorted(set(_paths(wrapper)), key=lambda p: (p.count("/"), p))
    last = {p: p.rsplit("/", 1)[1].split(".") for p in paths}
    mass = dict.fromkeys(paths, 0)
    for q, n in prose.items():
        at = q.find("/", 1)
        while at > 0:
            if q[:at] in mass:
                mass[q[:at]] += n
            at = q.find("/", at + 1)
        if q in mass:
            mass[q] += n

    def outermost(found: list[str]) -> list[str]:
        out: set[str] = set()
        for p in found:  # shorter ones come first
            steps = p.split("/")
            if not any("/".join(steps[:k]) in out for k in range(2, len(steps))):
                out.add(p)
        return sorted(out, key=lambda p: (p.count("/"), p))

    kinds = [
        outermost([p for p in paths if mass[p] and wanted(last[p])])
        for wanted in (lambda w: w[0] == "article", lambda w: w[0] == "main", lambda w: not MAIN.isdisjoint(w[1:]))]
    held = [sum(mass[p] for p in found) for found in kinds]
    for found, n in zip(kinds, held):
        if found and 2 * n >= max(held):
            return found
    total = sum(prose.values())
    heavy = [p for p in paths if 3 * mass[p] >= 2 * total and total]
    return heavy[-1:]


def blocks(nodes: list, mains: list[str], above: str = "", inside: bool = False) -> Iterator[str]:
    """The texts of a page that the wrapper's main paths bind, in page order."""
    for label, text, children in nodes:
        if label == "#":
            if inside:
                yield text
        elif label[0] != "!":
            path = f"{above}/{label}"
            within = inside or path in mains
            if within or any(m.startswith(path + "/") for m in mains):
                if label.split(".")[0] == "header":
                    children = [c for c in children if re.match(r"h[1-6](\.|$)", c[0])]
                yield from blocks(children, mains, path, within)


def _prose(nodes: list, above: str, into: dict[str, int]) -> dict[str, int]:
    for label, text, children in nodes:
        if label == "#":
            into[above] = into.get(above, 0) + len(text) - children
        elif label[0] != "!":
            _prose(children, f"{above}/{label}", into)
    return into


def host_of(url: str = "url") -> F.Column:
    """Host of a URL in lower case; the empty host stands for pages without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_streams(pages: DataFrame) -> DataFrame:
    """(host, skeleton, path, chars): a page's expression (path null) and its characters outside links per path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                found: dict[tuple, int] = {}
                for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                    nodes = tree(html.as_py() or "")
                    found[host, json.dumps(skeleton(nodes)), None] = 0
                    for path, n in _prose(nodes, "", {}).items():
                        found[host, None, path] = found.get((host, None, path), 0) + n
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.string()) for c in columns), pa.array(list(found.values()), pa.int64())],
                    ["host", "skeleton", "path", "chars"])

    return pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "host string, skeleton string, path string, chars long")


def wrappers(pages: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(host, wrapper, mains): one union-free regular expression per host as JSON, and its main paths.

    Every page of ``pages`` (url, html) takes part. Equal streams of a host are one row before any alignment; the rest
    meet in groups of about ``fan_in``, round by round, until a host has one expression.
    """
    streams = stored(page_streams(pages), "streams")
    level = streams.filter("path is null").select("host", "skeleton").distinct()
    prose = streams.filter("path is not null").groupBy("host", "path").agg(F.sum("chars").alias("chars"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(rows["skeleton"]):
            items = json.loads(text)
            whole = items if whole is None else align(whole, items)
        return pd.DataFrame({"host": rows["host"].iloc[:1], "skeleton": [json.dumps(whole)]})

    while True:
        level = stored(level, "expressions")
        sizes = level.groupBy("host").agg(F.count(F.lit(1)).alias("_n"))
        if sizes.filter("_n > 1").isEmpty():
            break
        level = (
            level.join(sizes, "host")
            .withColumn("_part", F.pmod(F.xxhash64("skeleton"), F.ceil(F.col("_n") / fan_in).cast("long")))
            .groupBy("host", "_part").applyInPandas(merge, "host string, skeleton string")
        )

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        wrapper = json.loads(rows["skeleton"].iloc[0])
        mains = main_paths(wrapper, dict(zip(rows["path"].dropna(), rows["chars"].dropna().astype(int))))
        return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [json.dumps(wrapper)], "mains": [mains]})

    return stored(
        level.join(prose, "host", "left").groupBy("host").applyInPandas(
            choose, "host string, wrapper string, mains array<string>"), "wrappers")


def extract(pages: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html; other columns are ignored).

    A page's text is what its host's wrapper binds in the main paths, without furniture inside, one block a line. A
    page on which the wrapper binds nothing is read by the wrapper of its own stream alone. Null, empty or markup-only
    pages have the empty text. Pages without a host share one wrapper. Repeated rows are extracted each. An empty
    table gives an empty result.
    """
    found = wrappers(pages, fan_in)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = []
                for html, mains in zip(batch.column(2), batch.column(3).to_pylist()):
                    nodes = tree(html.as_py() or "")
                    parts = list(blocks(nodes, mains or []))
                    if not parts:
                        parts = list(blocks(nodes, main_paths(skeleton(nodes), _prose(nodes, "", {}))))
                    texts.append("\n".join(parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host_of().alias("host"))
    return (
        rows.join(found.select("host", "mains"), "host", "left").select("page_id", "url", "html", "mains")
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
    )
