import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftspan.llm import flac, html, media, urls


def test_flac_round_trip():
    rng = np.random.default_rng(0)
    t = np.arange(192 * 3)
    payloads = [bytes(192), bytes([9]) * 384, bytes(range(192)), rng.integers(0, 256, 192 * 70, dtype=np.uint8).tobytes(), (128 + 90 * np.sin(t / 9)).astype(np.uint8).tobytes(), b"\x00\xff" * 96, b" text " * 32, (128 + np.cumsum(rng.integers(-2, 3, 192 * 5))).astype(np.uint8).tobytes()]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads and flac.encode([]) == [] and flac.decode([]) == []
    assert len(streams[4]) < 0.6 * len(payloads[4])
    head = flac.metadata(streams[3])
    assert head.samples == 192 * 70 and [s for s, _ in head.seek] == [0, 192 * 64]
    kinds = {streams[i][flac.metadata(streams[i]).frames + 6] >> 1 for i in range(len(streams))}
    assert {0, 1} <= kinds and any(8 <= k <= 12 for k in kinds)
    assert flac.encode(payloads)[2] == flac.encode([payloads[2]])[0]
    with pytest.raises(ValueError, match="multiples"):
        flac.encode([b"abc"])


def test_flac_linear_predictors_are_used():
    t = np.arange(192 * 8)
    wave = (128 + 60 * np.sin(t * 0.9) + 50 * np.sin(t * 1.7)).astype(np.uint8).tobytes()
    (stream,) = flac.encode([wave])
    at = flac.metadata(stream).frames
    assert stream[at + 6] >> 1 >= 32 and flac.decode([stream]) == [wave]


def test_damage_is_found():
    (stream,) = flac.encode([bytes(range(192)) * 3])
    for at in range(flac.metadata(stream).frames, len(stream), 5):
        bad = bytearray(stream)
        bad[at] ^= 16
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    bad = bytearray(stream)
    bad[30] ^= 1
    with pytest.raises(ValueError, match="MD5"):
        flac.decode([bytes(bad)])


def test_media(docs, pairs, empty):
    stored = media.encode_media(docs)
    text = {d: (t or "").encode() for d, t in pairs}
    for r in media.media_report(stored).collect():
        p = text[r["doc_id"]] + b" " * (-len(text[r["doc_id"]]) % 192 or (0 if text[r["doc_id"]] else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    rows = media.pcm_blocks(stored, 4).orderBy("doc_id", "sample_offset").collect()
    joined = {}
    for r in rows:
        assert r["sample_offset"] == len(joined.get(r["doc_id"], b""))
        joined[r["doc_id"]] = joined.get(r["doc_id"], b"") + bytes(r["pcm"])
    assert all(joined[d].rstrip(b" ") == t.rstrip(b" ") for d, t in text.items())
    assert media.media_report(media.encode_media(empty)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div><!-- x <p>no</p> -->
<article><header><h1>Title &amp; more</h1></header><p>First  <b>bold</b>
 line&nbsp;end<br>next<p>Second &eacute; &#233; &am <div class="ad banner">Buy</div><ul><li>one<li>two</ul>
<form><label>Mail</label><input></form><table><tr><td>a<td>b</table><aside>Aside</aside><section class="comments"><p>Reader</p></section></article>
<aside class="sidebar">Side</aside><footer>&copy; x</footer>"""
TEXT = "Title & more\nFirst bold line end next\nSecond é é &am\none\ntwo\na\nb"


def test_page():
    assert html.Page(PAGE).main_text() == TEXT
    assert html.Page("").main_text() == "" and html.Page("a < b & c").main_text() == "a < b & c"
    assert html.Page("<p>cut <a hre").main_text() == "cut" and html.Page("<script>x").main_text() == ""
    assert html.Page("<div>" * 3000 + "deep").main_text() == "deep"


def test_role_words_do_not_drop_whole_pages():
    story = "<p>A story that is told here.</p>"
    side = "<div class='sidebar'>Side</div>"
    for page in (f"<body class='single no-sidebar'>{story}{side}</body>", f"<article class='post comments-open'>{story}</article>{side}", f"<html><body><form>{story}{side}</form></body></html>", f"<div class='page has-sidebar'><article>{story}</article>{side}</div>"):
        assert html.Page(page).main_text() == "A story that is told here."
    comments = f"<article>{story}</article><section class='comments'>{'<p>Many words of a reader.</p>' * 9}</section>"
    assert html.Page(comments).main_text() == "A story that is told here."
    cards = f"<div>{story}</div><div class='related'><article>Teaser</article></div>"
    assert html.Page(cards).main_text() == "A story that is told here."


def test_style_trees(spark):
    body = "<html><body><div class='top'>Always the same</div><div class='content'><p>Story {0} goes on.</p></div><div class='end'>Same again</div></body></html>"
    rows = [(i, f"http://A.example/{i}", body.format(i), "x") for i in range(20)] + [(50, "http://b.example/1", body.format(50), "y"), (51, None, body.format(51), None), (52, "http://a.example/n", None, None), (53, "nourl", "", None), (54, "http://a.example/art", PAGE, "z"), (54, "http://a.example/art", PAGE, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, low string").repartition(4)
    for limit in (200_000, 0):
        got = {r["page_id"]: r for r in html.extract(df, broadcast_rows=limit).collect()}
        assert all(got[i]["text"] == f"Story {i} goes on." for i in range(20))
        assert got[50]["text"] == got[51]["text"].replace("51", "50") == "Always the same\nStory 50 goes on.\nSame again"
        assert got[52]["text"] == got[53]["text"] == "" and got[54]["text"] == TEXT and got[54]["n_chars"] == len(TEXT)
    tree = html.style_trees(df).where("host = 'a.example'")
    assert tree.where("pages >= 20 and importance < 0.2").count() >= 2
    assert html.extract(df.limit(0)).count() == 0


def test_tree_decides_on_pages_with_articles(spark):
    inside = "<html><body><div class='a'>Same top</div><article><p>Story {0} here.</p><div class='x'>Tell your friends</div></article></body></html>"
    cards = "<html><body><div class='story'>Body {0} of the page.</div><article>Teaser {0}</article></body></html>"
    copies = "<html><body><article><p>One story</p></article></body></html>"
    rows = [(i, "http://a.org/", inside.format(i)) for i in range(20)] + [(i, "http://b.org/", cards.format(i)) for i in range(20, 40)] + [(i, "http://c.org/", copies) for i in range(40, 60)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} here." for i in range(20))
    assert all(got[i] == f"Body {i} of the page.\nTeaser {i}" for i in range(20, 40))
    assert all(got[i] == "One story" for i in range(40, 60))


def made_page(rng, number, article):
    """A random page: some parts say the same on all pages, some on a few, some on one."""
    says = lambda: rng.choice(["Always the same", "Always the same", f"One of {rng.randrange(3)}", f"Line {rng.randrange(10**6)} of {number}"])
    part = lambda depth: ("p", "", [says()]) if depth == 0 or rng.random() < 0.4 else ("div", rng.choice("ab"), [part(depth - 1) for _ in range(rng.randrange(1, 4))])
    fixed = ("section", "top", [("p", "", ["Same top"]), ("div", "c", [("p", "", ["More of it"])])])
    rare = ("section", "rare", [("p", "", ["New" if number == 3 else "Old"])])  # little entropy: the weight of main elements decides
    story = ("article" if article else "div", "story", [("p", "", [f"Story {number}"]), fixed, rare, *(part(3) for _ in range(2))])
    return ("html", "", [("body", "", [fixed, story, rare, part(4)])])


def written(node):
    if isinstance(node, str):
        return node
    tag, style, parts = node
    return f"<{tag} class='{style}'>{''.join(map(written, parts))}</{tag}>"


def test_against_a_plain_style_tree(spark):
    rng, hosts = random.Random(5), {}
    for host, article, n in (("a.org", True, 24), ("b.org", False, 24), ("c.org", True, 7), ("d.org", False, 8)):
        pages = [made_page(rng, i, article) for i in range(n)]
        hosts[host] = pages + pages[:3]
    rows = [(f"{host}-{i}", f"https://{host}/{i}", written(page)) for host, pages in hosts.items() for i, page in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    whole = {k: html.Page(h).main_text() for k, _, h in rows}
    expected = {f"{host}-{i}": t for host, pages in hosts.items() for i, t in enumerate(brute.style_tree(pages, 8, 0.2))}
    assert got == expected
    assert all(got[k] == whole[k] for k in got if k.startswith("c")) and all(got[k] != whole[k] for k in got if k[0] in "ab")


def test_a_quote_without_partner_leaks_no_markup():
    assert html.Page('<div title="x>T</div>').main_text() == "T" and html.Page("<p>a</p><div title='x>T<p>b</p>").main_text() == "a\nT\nb"
    assert html.Page('<p title="a>b">T</p>').main_text() == "T" and html.Page('<p title="' + "'" * 50_000).main_text() == ""


def test_deep_elements_have_paths_of_their_own(spark):
    deep = "<div>" * 20 + "<div class='a'>Always the same</div><div class='b'>Story {0}</div>"
    got = html.extract(spark.createDataFrame([(i, "http://a.org/", deep.format(i)) for i in range(20)], "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Story {r['page_id']}" for r in got)
    page = html.Page("<div>x" * 50_000)
    assert len(page.nodes) == len(page.blocks) == 50_000 and page.main_text() == "\n".join("x" * 50_000)


RULES = urls.parse_rules("allow com/, block example.com/en/, allow www.example.com/en/, block net/es/, block net/fr/")


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = brute.re.match(r"[^/?#]*", rest)[0]
    path = brute.re.match(r"[^?#]*", rest[len(host) :])[0]
    host = brute.lower(host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules(spark):
    given = ["http://X.Example.com/en/1?q", "http://www.example.com/en/2", "https://a.net/es/x#t", "http://net/fr/", "http://net/fr", "ftp://b.org", "HTTP://com", "http://com/", "nothing", None, "http://a.b/x://c/d", "://h/p", "http://ÀB.net/es/", "http://notexample.com/en/", "http://u@h.com:80/p"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(given)], "page_id long, url string, html string")
    for r in urls.judge(df, RULES).collect():
        host, path, rule, verdict = plain_verdict(given[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert urls.judge(df.limit(0), RULES).count() == 0
    with pytest.raises(ValueError, match="allows or blocks"):
        urls.parse_rules("deny x/")


def test_aliases(spark):
    link = lambda to: f"<head><LINK href='{to}' REL=canonical></head>"
    go = lambda to: f'<meta http-equiv="Refresh" content="0; url={to}">'
    rows = [
        (1, "http://a.org/1", link("https://b.net/fr/x")),  # the target is blocked
        (2, "https://A.org/1#frag", None),  # the same page
        (3, "http://c.org/d/e?x=1", go("../1".replace("../", "http://a.org/"))),  # a chain
        (4, "http://d.org/", link("/y")), (5, "http://d.org/y", ""),  # no rule anywhere
        (6, "http://e.org/", link("//shop.com/")), (7, "http://e.org/z", link("http://b.net/es/")), (8, "http://e.org/z", go("http://e.org/")),  # allowed and blocked
        (9, "http://b.net/fr/x", link("http://shop.com/")), (10, "http://f.org/", "<a rel=canonical href='http://b.net/es/'>"), (None, "http://g.org/", link("javascript:void(0)")),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, node int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, RULES).collect()}
    # 9 joins the blocked chain to an allowed host, so the whole component is allowed; its own rule still blocks 9
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow", None: "allow"}
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df.where(F.col("page_id") < 6), RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_large_alias_graphs(spark):
    """Redirect chains, canonical cycles, a star of copies and random links, against plain components."""
    rng, rows, links = random.Random(9), [], []

    def page(url, to=None, redirect=False):
        tag = f"<meta http-equiv=refresh content='0;url={to}'>" if redirect else f"<link rel=canonical href='{to}'>"
        rows.append((len(rows), url, f"<head>{tag}</head>" if to else "<p>x</p>"))
        if to:
            links.append((url, to))

    for chain, end in ((0, "http://a.net/es/x"), (1, "http://shop.com/x"), (2, "http://plain.org/end")):
        for i in range(70):
            page(f"http://chain{chain}.org/{i}", f"http://chain{chain}.org/{i + 1}" if i < 69 else end, redirect=i % 2 == 0)
    for i in range(40):
        page(f"http://ring.org/{i}", f"http://ring.org/{(i + 1) % 40}")
    page("http://ring.org/7", "http://b.net/fr/ring")
    for i in range(1500):
        page(f"http://copy{i}.org/", "http://star.org/")
    page("http://star.org/", "http://c.net/es/star")
    for i in range(400):
        ends = rng.choices([f"http://r{rng.randrange(900)}.org/p", f"http://r{rng.randrange(900)}.com/p", f"http://r{rng.randrange(900)}.net/es/p"], [12, 1, 1])
        page(f"http://r{rng.randrange(900)}.org/p", ends[0])
    page("http://alone.org/")
    group, verdicts = brute.linked(links), {}
    for node, root in group.items():
        verdicts.setdefault(root, set()).add(plain_verdict(node)[3])
    spread = {root: next((v for v in ("allow", "block") if v in own), None) for root, own in verdicts.items()}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, RULES).collect()}
    assert got == {i: plain_verdict(u)[3] or spread.get(group.get(u)) or "allow" for i, u, _ in rows}
    assert sum(v == "block" for v in got.values()) > 1600 and got[0] == "block" and got[75] == "allow"
