"""URL rules that reach a page's aliases: connected components over redirects and canonical links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# What a scan of a page stops at. The text of the raw elements is no markup, and a template is not part of the page.
_RAW = "script|style|textarea|title|template|xmp|iframe"
_STOPS = re.compile(rf"<!--|<(?P<raw>{_RAW})(?=[\s/>])|<(?P<tag>link|meta|base)(?=[\s/>])", re.I | re.A)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in _RAW.split("|")}
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>)))?)""", re.A)
_REFRESH = re.compile(r"\s*(?:\d+|(?=\.))[\d.]*(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(?:\"([^\"]*)|'([^']*)|([^\"'].*))", re.I | re.S | re.A)


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from its name's end on, and where it ends; -1 if the page ends first."""
    found: dict[str, str] = {}
    while (m := _ATTRIBUTE.match(html, at)) and m.end() > at:
        at = m.end()
        if m[1]:
            return found, at
        found.setdefault(m[2].lower(), unescape(next((v for v in m.groups()[2:] if v is not None), "")))
    return found, -1


def targets(url: str | None, html: str | None) -> list[str]:
    """Where a page says it stands: absolute http(s) targets of rel=canonical links and of meta refreshes.

    Links inside comments, scripts and the other raw elements do not count. Relative targets are resolved against the
    first base element or the page's own url. The scan reads every character at most a few times.
    """
    if not html or "<" not in html:
        return []
    at, base, found = 0, None, []
    while at >= 0 and (stop := _STOPS.search(html, at)):
        at = stop.end()
        if stop["raw"]:
            end = _ENDS[stop["raw"].lower()].search(html, at)
            at = end.end() if end else -1
        elif not stop["tag"]:
            end = html.find("-->", at)
            at = end + 3 if end >= 0 else -1
        else:
            own, at = _attributes(html, at)
            if at < 0:
                break
            tag, link = stop["tag"].lower(), None
            if tag == "base" and base is None:
                base = own.get("href")
            elif tag == "link" and "canonical" in own.get("rel", "").lower().split():
                link = own.get("href")
            elif tag == "meta" and own.get("http-equiv", "").strip().lower() == "refresh":
                m = _REFRESH.match(own.get("content", ""))
                link = m and (m[1] or m[2] or m[3])
            if link and link.strip():
                found.append(link.strip())
    absolute = []
    for link in found:
        try:
            full = urljoin(urljoin(url or "", base or ""), link)
        except ValueError:  # no URL, such as an unclosed bracket in its host
            continue
        if full[:8].lower().startswith(("http://", "https://")):
            absolute.append(full)
    return absolute


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of every canonical link and meta refresh in ``pages`` (url, html), whole pages, one row each.

    Null or empty html and null urls give no link. Nothing is shuffled; a task holds one slice of 256 pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                part = whole.slice(start, 256)
                pairs = [
                    (url, target) for url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                    for target in targets(url, html)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["url", "target"])

    return (
        pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
        .filter("url is not null and html is not null").mapInArrow(run, "url string, target string"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def node_of(url: Column) -> Column:
    """The page a url names: scheme and host in lower case, no default port, no fragment, / for an empty path.

    Null for null or without ://.
    """
    scheme = F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER)
    port = F.when(scheme == "http", ":80").when(scheme == "https", ":443").otherwise("")
    host = host_of(url)
    bare = F.when((port != "") & F.endswith(host, port), F.left(host, F.length(host) - F.length(port))).otherwise(host)
    path = path_of(url)
    query = F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(
        scheme, F.lit("://"), bare, F.when(path == "", "/").otherwise(path), query))


def fitting_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the distinct ``places`` (host, path) that a rule (host, path, verdict) fits.

    A rule fits its host and all subdomains if the place's path starts with the rule's; the longest host and path
    together wins, then the longer host. Of two rules alike in both, allow wins. All steps are equalities: a host meets
    the rules' hosts by its ends, then a path meets the rules' paths by its beginnings of the lengths those rules have,
    so the rules may be many. A rule without host, path or verdict fits nothing; empty tables give an empty one.
    """
    own = (
        rules.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("_rh"), F.col("path").alias("_rp"), "verdict")
        .filter("_rh <> '' and _rp is not null and verdict is not null")
        .groupBy("_rh", "_rp").agg(F.min("verdict").alias("verdict")))  # allow < block
    labels = own.select(F.max(F.size(F.split("_rh", r"\."))).alias("n")).first()["n"]
    parts = F.split("host", r"\.")
    ends = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels or 1))),
        lambda n: F.concat_ws(".", F.slice(parts, -n, n)))
    lengths = own.groupBy("_rh").agg(F.collect_set(F.length("_rp")).alias("_lengths"))
    hosts = (
        places.select("host").distinct().withColumn("_rh", F.explode(ends)).join(lengths, "_rh")
        .select("host", "_rh", F.explode("_lengths").alias("_n")))
    return (
        places.join(hosts, "host").filter(F.length("path") >= F.col("_n"))
        .withColumn("_rp", F.left("path", F.col("_n"))).join(own, ["_rh", "_rp"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            (F.length("_rh") + F.col("_n")).alias("size"), F.length("_rh").alias("host_size"),
            F.concat("_rh", "_rp").alias("rule"), "verdict")).alias("_best"))
        .select("host", "path", F.col("_best")["rule"].alias("rule"), F.col("_best")["verdict"].alias("verdict")))


def alias_verdicts(links: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, verdict) for every page in a component of ``links`` (url, target) that a rule touches.

    Links count in both directions. A component with an explicitly allowed member is allowed, else one with a blocked
    member is blocked; components without either are left out. Self-links and links without a url are ignored.
    """
    edges = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).filter("a <> b").distinct()
    members = components(edges)
    placed = members.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    marks = (
        placed.join(fitting_rules(placed.select("host", "path").distinct(), rules), ["host", "path"])
        .groupBy("component").agg(F.min("verdict").alias("verdict")))  # allow < block
    return members.join(marks, "component").select("node", "verdict")


def judged(pages: DataFrame, links: DataFrame, rules: DataFrame, url: str = "url") -> tuple[DataFrame, str]:
    """Every row of ``pages`` with a struct (host, path, rule, verdict), and that column's name.

    The verdict is that of the rule that fits the page's own url (see ``fitting_rules``); without one it is the verdict
    of the page's aliases (see ``alias_verdicts``), and allow where those have none. ``links`` (url, target) may hold
    canonical links, meta refreshes and a crawler's redirects alike.

    A null url or one without :// has empty host and path, fits no rule, has no alias and is allowed. Repeated rows are
    judged each, alike. Other columns stay as they are; the struct is named ``judged`` with as many underscores as keep
    it apart. Empty pages give an empty table. Rules are found once per distinct host and path, aliases per distinct
    url; both come back by left joins whose other side has one row a key, so a busy host or url can be split.
    """
    name = "judged"
    while name in pages.columns:
        name += "_"
    address = F.col(f"`{url}`").cast("string")
    row = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), host_of(address).alias("host"),
        path_of(address).alias("path"), node_of(address).alias("node"))
    fits = fitting_rules(row.select("host", "path").distinct(), rules)
    near = alias_verdicts(links, rules).withColumnRenamed("verdict", "_alias")
    return row.join(fits, ["host", "path"], "left").join(near, "node", "left").select("_row.*", F.struct(
        "host", "path", "rule", F.coalesce("verdict", "_alias", F.lit("allow")).alias("verdict")).alias(name)), name
