"""URL rules and their aliases against a plain reading of pages, rules and components."""

from __future__ import annotations

import random
import time

import pytest
from wardlens.llm import redirects
from wardlens.llm.queries import URL_RULES

ROOT = "https://www.example.org/en/a/b.html"


@pytest.mark.parametrize("html, expected", [
    (None, []), ("", []), ("plain", []),
    ("<link rel=canonical href=http://x.net/>", ["http://x.net/"]),
    ("<LINK REL='alternate Canonical' HREF='../c'>", ["https://www.example.org/en/c"]),
    ('<link href="//y.org/?a=1&amp;b=2" rel="canonical"/>', ["https://y.org/?a=1&b=2"]),
    ('<link rel="stylesheet" href="/s"><link rel="canonical">', []),
    ('<base href="http://z.com/q/"><base href="http://no/"><link rel=canonical href=k>', ["http://z.com/q/k"]),
    ('<meta http-equiv="Refresh" content="0; URL=\'/moved\'">', ["https://www.example.org/moved"]),
    ('<meta http-equiv=refresh content="5;http://q.net/x">', ["http://q.net/x"]),
    ('<meta http-equiv=refresh content="5">', []),
    ('<!-- <link rel=canonical href=/a> --><script>"<link rel=canonical href=/b>"</script ><link rel=canonical href=/c>',
     ["https://www.example.org/c"]),
    ("<title><link rel=canonical href=/a></title><!-- open <link rel=canonical href=/b>", []),
    ('<link rel=canonical href="http://[bad/">', []), ("<link rel=canonical href=mailto:a@b>", []),
    ('<link title="a > b" rel=canonical href=/c>', ["https://www.example.org/c"]),
    ('<link rel=canonical href="/never closed', []), ("<linked rel=canonical href=/a>", []),
])
def test_targets_of_pages(html, expected):
    assert redirects.targets(ROOT, html) == expected


def test_broken_markup_is_read_in_one_go():
    began = time.monotonic()
    for html in ("<link " * 100_000, "<!--" * 300_000, '<link href="' * 100_000, "<script>" * 100_000, "<link" + " " * 10**6,
                 "<link a=" * 100_000, "<meta http-equiv=refresh content=' " + "1" * 10**6):
        redirects.targets(ROOT, html)
    assert time.monotonic() - began < 5


def plain_place(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:].split("#")[0].split("?")[0]


def plain_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def plain_node(url):
    if not url or "://" not in url:
        return None
    scheme, rest = url.split("://", 1)
    host, path = plain_place(url)
    host = host.removesuffix({"http": ":80", "https": ":443"}.get(scheme.lower(), "never"))
    bare = rest.split("#")[0]
    return f"{scheme.lower()}://{host}{path or '/'}" + (bare[bare.index("?"):] if "?" in bare else "")


def plain_verdicts(urls, links, rules):
    near = {}
    for a, b in ((plain_node(a), plain_node(b)) for a, b in links):
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for url in urls:
        host, path = plain_place(url)
        rule, verdict = plain_rule(host, path, rules)
        if verdict is None:
            seen, todo = set(), [plain_node(url)]
            while todo:
                node = todo.pop()
                if node in near and node not in seen:
                    seen.add(node)
                    todo += near[node]
            marks = {plain_rule(*plain_place(n), rules)[1] for n in seen} - {None}
            verdict = min(marks, default="allow")
        out.append((url, host, path, rule, verdict))
    return out


def test_verdicts_match_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.example.net", "net", "EXAMPLE.com", "b.example.com", "example.org", "x.org:80", "c.de", "d.de", "e.de", "planet", "net."]
    urls = [f"{rng.choice(['http', 'https', 'HTTP'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/x', '/fr', '/fr/y'])}"
            f"{rng.choice(['', '', '?q=1', '#t', '?q=1#t'])}" for _ in range(300)]
    links = [(rng.choice(urls), rng.choice(urls)) for _ in range(60)]
    links += [(urls[0], None), (None, urls[1]), (urls[2], urls[2]), ("nothing", urls[3])]
    links += [(f"http://chain.de/{k}", f"http://chain.de/{k + 1}") for k in range(40)] + [("http://chain.de/40", "http://z.net/")]
    urls += ["http://chain.de/0", "http://chain.de/17", None, "", "no address", "http://", "x://y://z/en/", urls[0], urls[0]]
    pages = spark.createDataFrame([(k, u, "r", 1) for k, u in enumerate(urls)], "page_id long, url string, rule string, judged int")
    frame = spark.createDataFrame(links, "url string, target string")
    rules = URL_RULES + [("x.org:80", "/fr/y", "block"), ("net", "/", "allow"), ("", "/", "block"), ("c.de", None, "block"), ("planet", "", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found, name = redirects.judged(pages, frame, table)
    assert (name, found.columns) == ("judged_", pages.columns + ["judged_"])
    got = {r.page_id: (r.url, *r[name]) for r in found.collect()}
    # of two rules alike in host and path, allow wins
    plain = plain_verdicts(urls, links, [r for r in rules if r != ("net", "/", "block")])
    assert got == dict(enumerate(plain))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "<p>")], "page_id long, url string, html string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    none = redirects.page_links(pages)
    assert none.collect() == []
    found, name = redirects.judged(pages, none, rules.limit(0))
    assert [tuple(r[name]) for r in found.collect()] == [("a.net", "/", None, "allow")]
    assert redirects.judged(pages.limit(0), none, rules)[0].collect() == []


def test_many_pages_behind_one_link(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://mirror.de/', id) as url",
                                         "'<link rel=canonical href=\"http://hub.net/\">' as html")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    found, name = redirects.judged(pages.select("page_id", "url"), redirects.page_links(pages), rules)
    assert found.filter(found[name]["verdict"] == "block").count() == 3000
