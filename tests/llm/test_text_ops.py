"""URL filter, HTML rendering, WARC archives, packing and decontamination."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import decontam, html_layout, packing, queries, url_filter, warc_shards


# ---------------------------------------------------------------- URLs

def judged(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for rule in rules:
        site, _, below = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + below) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


URLS = [
    None, "", "nothing", "http://A.Example.NET/en/x?q=1", "http://example.net/en", "http://example.net", "https://x.org/fr/1#t", "ftp://org/fr/",
    "http://notexample.com/de/1", "http://a.example.com/de/?x://y/z", "http://h?p/de/", "http://Ünï.net/a\nb", "x://y://z/net/", "http://forg/fr/", "http://a.org/fr/",
]


def test_rules_and_verdicts(spark):
    r = random.Random(1)
    made = [f"http://{''.join(r.choices('abc', k=6))}.{d}/{p}/{r.randrange(999)}" for d in ("example.net", "example.org", "example.com") for p in ("en", "de", "fr") for _ in range(60)]
    rows = [(k, u, "x") for k, u in enumerate([*URLS, *made, URLS[3], URLS[3]])] + [(None, "http://q.net/", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, rule string").selectExpr("*", "1 as score", "2 as host")
    got = url_filter.judge(df, queries.URL_RULES).collect()
    assert len(got) == len(rows)
    urls = {k: u for k, u, _ in rows}
    for x in got:
        host, path, rule = judged(urls[x["page_id"]], queries.URL_RULES)
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule)
        if rule:
            assert x["verdict"] == queries.URL_RULES[rule]
        assert x["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0
    alone = url_filter.judge(df.filter("page_id in (0, 1, 2)"), queries.URL_RULES).collect()
    assert [(x["verdict"], x["score"]) for x in alone] == [("allow", 0.0)] * 3


def test_model_tells_kinds_of_urls_apart(spark):
    r = random.Random(2)
    good = [f"http://site{r.randrange(99)}.good.org/fr/article-{r.randrange(999)}.html" for _ in range(300)]
    bad = [f"http://ads{r.randrange(99)}.net/click?id={r.randrange(9999)}&track=1" for _ in range(300)]
    asked = ["http://new.good.edu/fr/article-5.html", "http://ads7.com/click?id=77&track=1"]
    df = spark.createDataFrame(list(enumerate(good + bad + asked)), "page_id bigint, url string")
    got = {x["page_id"]: x for x in url_filter.judge(df, queries.URL_RULES).filter("page_id >= 600").collect()}
    assert got[600]["rule"] is None and (got[600]["verdict"], got[601]["verdict"]) == ("allow", "block")


def plain_ratio(urls, texts):
    """Witten-Bell models of labelled urls, character by character, without hashing."""
    seen = {c: [Counter() for _ in range(url_filter.ORDER + 1)] for c in (0, 1)}
    for url, label in urls:
        raw = url.encode().lower()
        for k in range(len(raw)):
            for order in range(url_filter.ORDER + 1):
                seen[label][order][bytes(max(0, order - k)) + raw[max(0, k - order) : k], raw[k]] += 1
    out = []
    for text in texts:
        raw, total = text.encode().lower(), 0.0
        for label in (0, 1):
            by = [({}, {}) for _ in seen[label]]
            for order, counts in enumerate(seen[label]):
                for (context, _), n in counts.items():
                    by[order][0][context] = by[order][0].get(context, 0) + n
                    by[order][1][context] = by[order][1].get(context, 0) + 1
            for k in range(len(raw)):
                p = 1 / url_filter.ALPHABET
                for order in range(url_filter.ORDER + 1):
                    context = bytes(max(0, order - k)) + raw[max(0, k - order) : k]
                    n, kinds = by[order][0].get(context, 0), by[order][1].get(context, 0)
                    if n:
                        p = (seen[label][order][context, raw[k]] + kinds * p) / (n + kinds)
                total += (2 * label - 1) * math.log(p)
        out.append(total / max(1, len(raw)))
    return out


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_scores_equal_plain_models(monkeypatch, piece):
    monkeypatch.setattr(url_filter, "PIECE", piece)
    r = random.Random(8)
    urls = [(f"http://a{r.randrange(9)}.b/c{r.randrange(30)}", k % 2) for k in range(60)] + [("x" * 40 + "é", 1), ("", 0)]
    counts, home = np.zeros(2 * (url_filter.ORDER + 1) * 2 * url_filter._PER, np.int64), np.full(2 * (url_filter.ORDER + 1) * 2 * url_filter._PER, -1)
    batch = pa.RecordBatch.from_pydict({"url": [u for u, _ in urls], "label": pa.array([c for _, c in urls], pa.int32())})
    for made in url_filter._count(iter([batch])):
        at = made.column("cell").to_numpy()
        counts[at], home[at] = made.column("n").to_numpy(), made.column("home").to_numpy()
    texts = ["http://a3.b/c77", "", "zzz", "xxxxxxxx", "http://a1.b/c2é"]
    got = url_filter.Ratio(counts, home)(pa.array(texts))
    # contexts that meet in one of 32,768 cells are rare here
    assert got == pytest.approx(plain_ratio(urls, texts), abs=2e-2)


def test_calibration():
    assert -0.05 < url_filter.calibrate([(0, -9, 5), (1, 8, 5)]) < 0.05
    assert url_filter.calibrate([]) == pytest.approx(-0.005)


# ---------------------------------------------------------------- HTML

@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b", "a\n\nb"),
        ("a <b>b</b>c   d\n e", "a bc d e"),
        ("<ul><li>x<li>y<ol start=3><li>q</ol></ul>", "- x\n- y\n  3. q"),
        ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
        ("<table><td>only", "only"),
        ("<div hidden>n</div><p style='display : none'>n</p><i aria-hidden=true>n</i>y", "ny"),
        ("<script>var t='</p>';</script><style>p{}</style>x<!-- c -->", "x"),
        ("<head><title>T &amp; U</title><meta x></head><body>b", "T & U\n\nb"),
        ("a<br>b<hr>c", "a\nb\nc"),
        ("<pre>k\n  l</pre>", "k\n  l"),
        ("<img alt=pic> <input type=hidden value=n><input type=submit value=go>", "pic go"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("</p></div>x</b>", "x"),
        ("<p title='a>b'>q<a href=\"x", "q"),
        ("1 < 2 & 3 > 2", "1 < 2 & 3 > 2"),
        ("<tr><td>stray", "stray"),
        ("<ul><li>a<table><tr><td>1<td>2</table></ul>", "- a\n\n  1  2"),
        ('<p title=5">a</p><p>b', "a\n\nb"), ('<p title="5>a</p><p>b', "a\n\nb"), ("<p \x0bx='1' /y>a", "a"),
        ("<template><p>x<template>y</template>z</template>w", "w"),
        ("<div style='visibility:hidden'>n<b style='visibility:visible'>y</b>n</div>", "y"),
        ("<svg><text>s</text><title>t</title></svg>", "s"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>", "wide  z\n1  2  3"),
        ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"), ("<li>a<li>b", "- a\n- b"),
        ("<p>a<span style='display:block'>b</span>c", "a\nb\nc"),
        ("<table><tr><td>a<ul><li>x<li>y</ul><td>q</table>", "a    q\n- x\n- y"),
        ("<table><tr><td><table><tr><td>1<td>2</table><td>z</table>", "1  2\n\nz"),
        ("<div><ul><li>a</div>b", "- a\n\nb"), ("<select><option>a<option>b</select>", "a\nb"),
        ("a<!-->b<!--->c<!-- x --!>d", "abcd"), ("<td>x</td></table>y", "xy"),
        ("", ""), (None, ""), ("   \n", ""), ("<", "<"), ("<p", ""), ("<!doctype html>", ""),
    ],
)
def test_layout(page, text):
    assert html_layout.page_text(page) == text


def test_deep_pages_do_not_overflow():
    assert html_layout.page_text("<div>" * 20_000 + "x") == "x"
    assert "x" in html_layout.page_text("<table><tr><td>x" * 2000)
    assert html_layout.page_text("<ul><li>" * 3000 + "x").strip("- ") == "x"


@pytest.mark.parametrize(
    "page",
    [
        "<div>x" * 150_000, "<b>" * 330_000, "<b><table><tr><td>" + "<div>" * 20_000 + "</b>" * 200_000, "<table><tr><td>x" * 60_000,
        "<ul><li>x" * 110_000, "<table><tr>" + "<td colspan=1000>x" * 50_000, "<table>" + "<tr><td rowspan=9>x<td>y" * 40_000,
        "<p a=\"'>x" * 100_000, "<table><tr><td>" + "w " * 250_000 + "<tr>" + "<td>a<td>b<tr>" * 40_000, "<!--x" * 200_000,
    ],
)
def test_hostile_pages_take_seconds(page):
    began = time.process_time()
    out = html_layout.page_text(page)
    assert time.process_time() - began < 5 and len(out) < 10 * len(page)


def made(r, depth=0):
    """A random element: (kind, parts)."""
    words = lambda: " ".join(r.choices(["ab", "c", "défg", "x & y", "1 < 2"], k=r.randrange(1, 4)))
    kinds = ["text", "text", "p", "br", "hidden", "pre"] + (["div", "ul", "ol", "table", "quote"] if depth < 3 else [])
    kind = r.choice(kinds)
    if kind in ("text", "pre", "hidden"):
        return kind, words()
    if kind == "p":
        return kind, [("text", words())]
    if kind in ("ul", "ol"):
        return kind, [[made(r, depth + 1) for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(1, 4))]
    if kind == "table":
        return kind, [[words() if r.random() < 0.9 else "" for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(1, 4))]
    return kind, [made(r, depth + 1) for _ in range(r.randrange(1, 4))] if kind != "br" else None


def markup(r, node):
    kind, parts = node
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    many = lambda nodes: "".join(markup(r, n) for n in nodes)
    leave = lambda tag: r.choice([tag, ""])
    if kind == "text":
        return f" {esc(parts)} "
    if kind == "hidden":
        return r.choice(["<div hidden>{}</div>", "<script>{}</script>", "<i style='color:red;display:none'>{}</i>", "<!--{}-->"]).format(esc(parts))
    if kind == "pre":
        return f"<pre>{esc(parts)}</pre>"
    if kind == "br":
        return "<br>"
    if kind == "p":
        return f"<p>{many(parts)}</p>"
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{many(x)}{leave('</li>')}" for x in parts) + f"</{kind}>"
    if kind == "table":
        row = lambda cells: leave("<tbody>") + "<tr>" + "".join(f"<td>{esc(c)}{leave('</td>')}" for c in cells) + leave("</tr>")
        return f"<table>{''.join(row(cells) for cells in parts)}</table>"
    return {"div": "<div>{}</div>", "quote": "<blockquote>{}</blockquote>"}[kind].format(many(parts))


def events(node, nested=False):
    """Text, breaks (None) and gaps (numbers) of an element, as a list; indents are part of lines."""
    kind, parts = node
    if kind == "text":
        return [parts]
    if kind == "hidden":
        return []
    if kind == "br":
        return [None]
    if kind in ("p", "pre", "div"):
        gap = 1 if kind == "div" else 2
        return [gap, *([parts] if kind == "pre" else [e for n in parts for e in events(n, nested)]), gap]
    if kind == "table":
        width = [max((len(row[k]) for row in parts if k < len(row)), default=0) for k in range(max(map(len, parts)))]
        begin = [sum(w + 2 for w in width[:k] if w) for k in range(len(width))]
        rows = []
        for row in parts:
            line = ""
            for k, cell in enumerate(row):
                line = line.ljust(begin[k]) + cell if cell else line
            rows.append(line)
        return [2, *(e for line in rows if line for e in (("line", line), 1)), 2]
    if kind == "quote":
        return [2, *indented([e for n in parts for e in events(n, nested)], " " * 4, " " * 4), 2]
    out = [1 if nested else 2]
    for k, item in enumerate(parts):
        mark = f"{k + 1}. " if kind == "ol" else "- "
        out += [1, *indented([e for n in item for e in events(n, True)], mark, " " * len(mark)), 1]
    return [*out, 1 if nested else 2]


def joined(parts):
    """Runs of text as lines."""
    out, now = [], None
    for e in parts:
        if isinstance(e, str):
            now = f"{now} {e}" if now is not None else e
            continue
        if now is not None:
            out.append(("line", now))
            now = None
            if e is None:
                out.append(1)
                continue
        out.append(("line", "") if e is None else e)
    return out + ([("line", now)] if now is not None else [])


def indented(parts, first, rest):
    out, lead = [], first
    for e in joined(parts):
        if isinstance(e, tuple):
            out.append(("line", lead + e[1] if e[1] or lead == first else e[1]))
            lead = rest
        else:
            out.append(e)
    return out


def plain(nodes):
    lines, gap = [], 0
    for e in joined([e for n in nodes for e in events(n)]):
        if isinstance(e, int):
            gap = max(gap, e)
        elif not e[1].strip():
            lines.append("")
        else:
            lines += [""] * (gap - 1) if lines else []
            gap = 0
            lines.append(e[1].rstrip())
    return "\n".join(lines).strip("\n")


def test_random_pages_equal_a_plain_renderer():
    r = random.Random(11)
    for _ in range(400):
        nodes = [made(r) for _ in range(r.randrange(1, 6))]
        # line breaks inside lists and quotes make empty marked lines; they are tested apart
        if "'br'" in repr(nodes):
            nodes = [n for n in nodes if "'br'" not in repr(n)]
        page = "".join(markup(r, n) for n in nodes)
        assert html_layout.page_text(page) == plain(nodes), page


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None), (None, "b")], "page_id bigint, html string").selectExpr("*", "'x' as text")
    assert sorted(map(tuple, html_layout.visible_text(df).collect()), key=str) == [(1, "a"), (1, "a"), (2, ""), (None, "b")]
    assert html_layout.visible_text(df.limit(0)).count() == 0


# ---------------------------------------------------------------- WARC

def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [(1, "http://a/", "x"), (2, "http://b/\r\nEvil: 1", "x"), (3, None, ""), (4, "u", None), (5, "u", "é" * 3000), (9, "u", "x"), (9, "u", "x"), (None, "u", "x"), (11, "u", "only")]


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'x' as sha", "'x' as seen", "1 as target")
    uri = f"file://{tmp_path}/warc"
    entries = warc_shards.write_archives(df, uri, roll_bytes=400, ranges=2)
    got = sorted(map(tuple, warc_shards.read_archives(spark, uri).collect()), key=str)
    x, empty = b32(b"x"), b32(b"")
    want = [
        (1, 1, x, "revisit", 9), (2, 1, x, "revisit", 9), (3, 0, empty, "revisit", 4), (4, 0, empty, "response", None),
        (5, 6000, b32(("é" * 3000).encode()), "response", None), (9, 1, x, "response", None), (9, 1, x, "revisit", 9),
        (None, 1, x, "response", None), (11, 4, b32(b"only"), "response", None),
    ]
    assert got == sorted(want, key=str)
    assert len(entries) > 2 and sorted(p.name for p in (tmp_path / "warc").iterdir()) == sorted([e["file"] for e in entries] + ["manifest.jsonl"])
    for e in entries:
        raw = (tmp_path / "warc" / e["file"]).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (e["bytes"], e["sha256"])
    again = warc_shards.write_archives(df, f"file://{tmp_path}/other", roll_bytes=400, ranges=2)
    assert json.dumps(again) == json.dumps(entries)  # the same bytes again
    fields, block = warc_shards.parse_record(zlib.decompress((tmp_path / "warc" / entries[0]["file"]).read_bytes(), 31))
    assert fields["WARC-Payload-Digest"].startswith("sha1:") and block.startswith(b"HTTP/1.1 200 OK\r\n")


def test_archives_of_nothing_and_small_payloads(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    assert warc_shards.round_trip(df.limit(0), f"file://{tmp_path}/none").count() == 0
    got = warc_shards.round_trip(df, f"file://{tmp_path}/min", min_revisit_bytes=5).collect()
    assert {r["record_type"] for r in got if r["page_id"] != 9} == {"response"}
    (tmp_path / "min").joinpath("part-999999-00000.warc.gz").write_bytes(b"left over")
    assert warc_shards.read_archives(spark, f"file://{tmp_path}/min").count() == len(PAGES)


# ---------------------------------------------------------------- packing

def test_packing_is_whole_and_tight(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    tok = Tokenizer.from_file(path)
    got = packing.packed_sequences(odd_docs, path, 512).collect()
    want = {}
    for r in odd_docs.select("doc_id", "text").distinct().collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[r["doc_id"], k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert len(got) == sum(3 if i == 0 else 1 for i, _ in want)
    check_places(got, 512)
    assert packing.packed_sequences(no_docs, path, 512).count() == 0


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def exact_bins(lengths, capacity):
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in {x: i for i, x in enumerate(bins)}.values():
            if bins[b] + lengths[k] <= capacity:
                bins[b] += lengths[k]
                go(k + 1, bins)
                bins[b] -= lengths[k]
        bins.append(lengths[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_solver_against_exhaustive_search():
    r = random.Random(3)
    over = 0
    for _ in range(200):
        lengths = [r.randrange(1, 21) for _ in range(r.randrange(1, 11))]
        histogram = {x: lengths.count(x) for x in lengths}
        runs, stats = packing.solve(histogram, 20)
        best = exact_bins(lengths, 20)
        over += stats["sequences"] - best
        assert best <= stats["sequences"] <= best + 1 and stats["bound"] <= best
        placed = {}
        used = {x: set() for x in lengths}
        for length, first, last, sequence, offset in runs:
            for rank in range(first, last):
                assert rank not in used[length]
                used[length].add(rank)
                placed.setdefault(sequence + rank - first, []).append((offset, length))
        assert {x: len(v) for x, v in used.items()} == histogram
        for parts in placed.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 20
    assert over <= 6


def test_reduction_fixes_only_what_some_best_packing_holds():
    r = random.Random(8)
    for _ in range(120):
        lengths = [r.randrange(8, 21) for _ in range(r.randrange(2, 10))]
        _, stats = packing.solve({x: lengths.count(x) for x in lengths}, 20)
        assert stats["sequences"] == exact_bins(lengths, 20)


def test_fast_words_equal_the_tokenizer():
    tok = packing.WordTokenizer(packing.vocabulary())
    words = ["Hello,world's", "$$$", "àéî", "x1y22", "DON'T!!", "a.b.c", "\u0130", "ΟΔΟΣ", "<|endoftext|>", "e\u0301", "数字", "\u00a0x", "'s'll"]
    words += [f"{a}{b}" for a in ("th", "Enß", "ción", "***") for b in ("ing", ",", "42", "ñ$$$")]
    assert tok._fast is not None
    got = tok.encode([" \n".join(words).encode(), b"", *[w.encode() for w in words]])
    want = [tok.slow.encode(t, add_special_tokens=False).ids for t in (" \n".join(words), "", *words)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


# ---------------------------------------------------------------- decontamination

ITEMS = [
    (1, "A train leaves Boston at 60 km per hour with 3 wagons and after 60 minutes it has gone how far"),
    (2, "what is the capital of the old northern kingdom by the sea"),
    (3, "seven short words make this small item"), (4, None), (5, ""), (None, "an item without an id has no name to report at all"),
]


def test_templates_and_slots(spark):
    docs = [
        (10, "Well. A train leaves Paris at 80 km per hour with 5 wagons and after 80 minutes it has gone how far?"),  # consistent
        (11, "A train leaves Paris at 80 km per hour with 5 wagons and after 90 minutes it has gone how far"),  # 60 maps to 80 and 90
        (12, "so WHAT is the capital, of the old northern kingdom by the sea; tell"),
        (13, "what is the capital of the new southern republic by the lake"),
        (14, "text seven short words make this small item text"), (15, None), (16, ""), (17, "seven short words make this small thing"),
        (18, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"), (12, "what is the capital of the old northern kingdom by the sea"),
        (19, "what is the capital of the old northern kingdom very by the sea"), (None, "what is the capital of the old northern kingdom by the sea"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as hash", "3 as slots", "'q' as item_id")
    b = spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "'x' as id", "0 as size")
    for bound in (decontam.BROADCAST_WINDOWS, 0):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b, broadcast_windows=bound).collect()}
        assert set(got) == {(10, 1), (12, 2), (14, 3), (19, 2)}
        assert got[10, 1]["reparameterised"] and not got[12, 2]["reparameterised"]
        assert got[14, 3]["matched_words"] == got[14, 3]["item_words"] == 7
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    word = lambda: f"w{r.choice('abcdefgh')}{r.choice('abcdefgh')}{r.choice('abcdefgh')}"
    items = [(k, " ".join(word() for _ in range(r.randrange(9, 40)))) for k in range(20)]
    docs = []
    for k in range(200):
        body = [word() for _ in range(r.randrange(5, 120))]
        if k % 3 == 0:
            i = items[r.randrange(20)][1].split()
            body[3:3] = i[: r.randrange(4, len(i) + 1)]
        docs.append((k, " ".join(body)))
    want = set()
    for i, a in items:
        a = a.split()
        grams = {tuple(a[k : k + 8]): k for k in range(len(a) - 7)}
        for j, t in docs:
            t = t.split()
            cover = {p for k in range(len(t) - 7) if tuple(t[k : k + 8]) in grams for p in range(grams[tuple(t[k : k + 8])], grams[tuple(t[k : k + 8])] + 8)}
            if len(cover) >= -(-len(a) * 6 // 10):
                want.add((j, i))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want and len(want) > 15


def test_decontamination_odd_rows(spark, odd_docs, tmp_path):
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = decontam.stage(spark, odd_docs, str(tmp_path))
    assert left.columns == odd_docs.columns
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert 0 not in ids and 6 not in ids and None in ids and len(ids) == odd_docs.count() - 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><p>Hello", "T\n\nHello"),
        ("<head><meta x> \n<title>T</title> Hello <b>you</b>", "T\n\nHello you"),
        ("<head><script>n</script><link rel=x><style>n</style><div>a</div></head>b", "a\nb"),
        ("<p>a <svg width=1><title>n</title><defs><text>n</text></defs><text x=1>one</text><text>two</text></svg><p>b", "a\none\ntwo\n\nb"),
        ("x <math><semantics><mi>y</mi><mo>=</mo><mn>2</mn><annotation>n</annotation></semantics></math> z", "x y=2 z"),
    ],
)
def test_layout_without_body_tags(page, text):
    assert html_layout.page_text(page) == text


def test_numbers_are_found_word_for_word(spark):
    items = [(1, "Compute 3.14 * 2.72 + 1.41 - 0.58"), (2, "add 12 34 56"), (3, "If x is 5 and y is 7 then 12 19 31 50 81 131 212 343 come next")]
    docs = [
        (10, "Q: Compute 3.14 * 2.72 + 1.41 - 0.58 = ?"), (11, "Compute 3.15 * 2.73 + 1.42 - 0.59"), (12, "so add 12 34 56 up"), (13, "add 12 34 57"),
        (14, "if x is 5 and y is 7 then 12 19 31 50 81 131 212 343 come next"), (15, "if x is 6 and y is 8 then 13 20 32 51 82 132 213 344 come next"),
    ]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["matched_words"], r["passages"], r["reparameterised"]) for r in got} == {
        (10, 1): (9, 1, False), (12, 2): (4, 1, False), (14, 3): (19, 1, False), (15, 3): (12, 1, True),
    }


def test_a_slot_that_changes_late_costs_its_windows_only(spark):
    item = (
        "a train leaves the old station at 5 in the morning and needs 3 hours to reach the far coast where 5 ships wait for the "
        "people on board until the tide turns and the harbour master counts all 3 crews once more before 5 bells are rung"
    )
    late = item.replace("before 5", "before 9")
    other = item.replace("5", "8").replace("3", "4")
    both = other.replace("before 8", "before 6")
    long = " ".join(f"step {k} turn the wheel and hold it for 7 turns until lamp {'abcdefghijkl'[k]} is lit" for k in range(12))
    far = long.replace("7", "6")[:-40] + long.replace("7", "9")[-40:]
    docs = [(1, f"intro {late} end"), (2, other), (3, both), (7, far), (None, item), (4, "we met in paris last year"), (5, "Paris!"), (6, "so 12 and 15")]
    items = [(10, item), (11, "Paris"), (12, "so 13 and 16"), (13, long)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b).collect()}
    # in document 3, one value of a short item stands for two
    assert sorted(got) == [(1, 10), (2, 10), (5, 11), (6, 12), (7, 13)]
    n = len(item.split())
    assert got[2, 10]["matched_words"] == n and got[2, 10]["reparameterised"] and n - 16 < got[1, 10]["matched_words"] < n


def test_the_stage_judges_texts(spark, tmp_path):
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(None, "x the quick brown fox jumps over the lazy dog again"), (7, "the quick brown fox jumps over the lazy dog again y"), (7, "clean words"), (None, None)]
    left = decontam.stage(spark, spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as leak_text"), str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == [(7, "clean words"), (None, None)]


def test_covered_columns_equal_a_plain_table():
    """Spans against a table of single columns: the last cell that takes a column holds it up to its own row."""
    r = random.Random(12)
    for _ in range(300):
        spans, plain, at = html_layout._Covered(), {}, 0
        for row in range(30):
            spans.row(row)
            plain = {c: until for c, until in plain.items() if until > row}
            at = 0
            for _ in range(r.randrange(5)):
                while at in plain:
                    at += 1
                assert spans.free(at) == at
                wide, tall = r.choice([1, 1, 2, 5, 9]), r.choice([1, 1, 2, 3, 8, 65534])
                if tall > 1:
                    spans.cover(at, at + wide, row + tall)
                    plain |= dict.fromkeys(range(at, at + wide), row + tall)
                at += wide
                edge = r.randrange(40)
                want = edge
                while want in plain:
                    want += 1
                assert spans.free(edge) == want


@pytest.mark.parametrize("rest", ["<tr>", "<tr><td>y", "<tr><td rowspan=3 colspan=7>y", "<td colspan=1000 rowspan=0>x", "<tr><td rowspan=0 colspan=1000>x", "<tr><td rowspan=65534>x<td rowspan=9>z"])
def test_a_megabyte_of_spans(rest):
    page = "<table><tr>" + "<td colspan=1000 rowspan=0>x" * 20 + rest * (1_000_000 // len(rest))
    began = time.process_time()
    html_layout.page_text(page)
    assert time.process_time() - began < 20


def test_a_worker_makes_its_tokenizer_once():
    import public_tokenizers

    from fathomline.llm import packing as own

    path = public_tokenizers.path("word_bpe_49k.json")
    assert own._tokenizer(path) is own._tokenizer(path)
