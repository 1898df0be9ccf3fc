import random
import re
import time

import pytest
from pyspark.sql import functions as F

from flowsentry.llm.htmlblocks import extract, main_text, second_pass
from flowsentry.llm.queries import RULES
from flowsentry.llm.urltrust import Rule, judge, propagate

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_rule(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (found[1].translate(LOWER), found[2]) if found else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_equal_brute_force(spark, table):
    odd = [None, "", "no-scheme/x", "http://", "HTTP://Sub.EXAMPLE.org/es/1?x", "http://org/", "http://org", "http://notorg/a",
           "http://a.example.org/en/12#y", "x://com/fr/", "http://com/de/#", "http://É.com/fr/x", "a://b://c.org/d", "http://example.org\n/es/"]
    rows = [(i, u, "<a href='http://q/'>") for i, u in enumerate(odd)] + [(100, None, None), (100, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).union(
        table("pages").select("page_id", "url", "html", F.lit(1)))
    urls = [r.url for r in pages.collect()]
    found = judge(pages, RULES).collect()
    want = sorted(map(str, map(brute_rule, urls)))
    assert sorted(str((r.host, r.path, r.rule, r.verdict if r.rule else None)) for r in found) == want
    assert {r.verdict for r in found} <= {"allow", "block"} and judge(pages.limit(0), RULES).count() == 0


def test_distrust_runs_against_links_and_trust_along_them(spark):
    pages = [("http://good/1", "<a href='http://friend/'>x</a>"), ("http://friend/1", ""), ("http://bad/1", ""),
             ("http://farm/1", "<A HREF = //BAD/2>y</A> <a href=/own>z</a>"), ("http://lonely/1", None)]
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    found = {r.host: r for r in judge(frame, [Rule("good", "/", "allow"), Rule("bad", "/", "block")]).collect()}
    assert found["friend"].trust > 0 and found["friend"].verdict == "allow" and found["friend"].rule is None
    assert found["farm"].distrust > 0 and found["farm"].verdict == "block"
    assert found["lonely"].verdict == "allow" and found["bad"].verdict == "block"


def test_propagation_equals_plain_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "c", 1)]
    seeds = [("a", 1.0, 0.0), ("c", 0.5, 0.5), ("d", 0.0, 1.0)]
    found = {r.host: r for r in propagate(spark.createDataFrame(edges, "source string, target string, links long"),
                                          spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    for kind, along in (("trust", edges), ("distrust", [(t, s, n) for s, t, n in edges])):
        start = {h: (x if kind == "trust" else y) for h, x, y in seeds}
        level = dict(start)
        total = {}
        for s, _, n in along:
            total[s] = total.get(s, 0) + n
        whole = sum(start.values())
        for _ in range(200):
            moved = {h: 0.7 * sum(level.get(s, 0) * n / total[s] for s, t, n in along if t == h) for h in "abcd"}
            level = {h: moved[h] + (whole - sum(moved.values())) * start.get(h, 0) / whole for h in "abcd"}
        assert all((found[h][kind] if h in found else 0) == pytest.approx(level[h], rel=1e-5) for h in "abcd")


def test_long_chains_are_followed_to_their_end(spark):
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(40)] + [(f"h{i}", f"x{i}", 3) for i in range(0, 40, 7)]
    found = {r.host: r for r in propagate(spark.createDataFrame(edges, "source string, target string, links long"),
                                          spark.createDataFrame([("h40", 0.0, 1.0), ("good", 1.0, 0.0)], "host string, trust double, distrust double")).collect()}
    assert all(found[f"h{i}"].distrust > found[f"h{i - 1}"].distrust > 0 for i in range(1, 41)) and "x7" not in found
    assert sum(r.distrust for r in found.values()) == pytest.approx(1) and found["good"].trust == pytest.approx(1)


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></ul></nav><header><p>Site</p></header><div class="cookie-notice">We use cookies</div>
<article><header><h1>A &amp; B</h1></header><p><b>One<br>two &lt;x&gt;<p>Three&nbsp; four</p><ul><li>item<li>other</ul>
<aside>see also</aside><form><input value=q><p>Search</p></form><table><tr><td>cell<td>next</table><!-- no --></article>
<section id="comments"><article><p>I disagree with all that</p></article></section><footer>&copy; x</footer></body></html>"""


def test_articles_without_furniture():
    assert main_text(ARTICLE) == "A & B\nOne two <x>\nThree four\nitem\nother\ncell\nnext"
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<nav>x</nav>") == ""


def test_blocks_without_a_marked_article():
    prose = "The cat sat on the mat and it was the best of all the days that they had in that house by the sea. " * 3
    page = (f"<div><a href=/>Home</a> <a href=/x>News</a></div><h1>Title of it</h1><p>{prose}</p><p>A short one.</p>"
            f"<p>{prose}</p><p>One more, short.</p><div>Terms <a href=/t>here</a></div>")
    assert main_text(page).split("\n") == ["Title of it", prose.strip(), "A short one.", prose.strip(), "One more, short."] \
        or main_text(page).split("\n")[:4] == ["Title of it", prose.strip(), "A short one.", prose.strip()]


PROSE = "The cat sat on the mat and it was the best of all the days that they had in that house by the sea. " * 3


def test_marked_wrappers_are_evidence():
    body = f"<article><div class='entry-header'><h1>Headline</h1></div><p>{PROSE}</p><section id='social-impact'><p>Impact</p></section></article>"
    want = ["Headline", PROSE.strip(), "Impact"]
    for wrapper in ("div class='content no-sidebar'", "div class='page has-sidebar'", "div class='elementor-widget'", "form", "div class='widget'"):
        page = f"<{wrapper}>{body}<div class='sidebar'><p>{PROSE}</p></div></{wrapper.split()[0]}>"
        assert main_text(page).split("\n") == want
    assert main_text(f"<form><h1>Headline</h1><p>{PROSE}</p></form>").split("\n") == want[:2]
    assert main_text(f"<article><p>{PROSE}</p></article><div id='comments'><p>{PROSE * 5}</p></div>") == PROSE.strip()


def test_densities_decide_on_pages_with_an_article():
    teasers = "".join(f"<article><h2><a href=/{i}>Teaser {i}</a></h2><p>Short words {i}</p></article>" for i in range(4))
    assert main_text(f"<div><p>{PROSE}</p><p>{PROSE}</p></div>{teasers}").split("\n")[:2] == [PROSE.strip()] * 2
    links = "".join(f"<li><a href=/{i}>Another story of ours number {i}</a></li>" for i in range(5))
    assert main_text(f"<article><p>{PROSE}</p><h3>More</h3><ul>{links}</ul><p>{PROSE}</p><p>End.</p><p>Yes.</p></article><footer>x</footer>") \
        == "\n".join([PROSE.strip()] * 2 + ["End.", "Yes."])


def test_texts_in_other_languages():
    for text in ("Il gatto dormiva sul tappeto vicino alla finestra mentre fuori pioveva forte. " * 4, "Кошка спала на ковре у окна, пока шёл дождь. " * 6,
                 "猫在窗边的地毯上睡着了，外面下着大雨。" * 10):
        page = f"<div><a href=/>Home</a></div><p>{text}</p><p>{text}</p>"
        assert main_text(page) == f"{text.strip()}\n{text.strip()}"


def test_no_page_ends_the_job():
    rng = random.Random(3)
    pieces = ["<![foo[x]]>", "<![CDATA[a", "<!", "<?", "<", ">", "</", "</>", "<p", "<a href=\"", "'", "<script>", "</script", "<title>", "<!--", "-->", "<br/>",
              "&amp", "&#0;", "&#xFFFFFFF;", "text ", "\x00", "<div class='ad x' id=", "<main", "<svg/>", "<noscript>", "</body>", "<td>", "<TABLE>", "=", "/", "É", "İ"]
    for _ in range(4000):
        assert "\n\n" not in main_text("".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))))
    assert main_text(f"<![foo[x]]><p>{PROSE}</p><![CDATA[abc<p>more</p>") == PROSE.strip() + "\nmore"


def test_what_is_left_open_hides_nothing():
    for start in ("<html><head><title>T</title><body>", "<html><head><title>T<body>", "<head><meta charset=x><title>T</title>", "<noscript>Turn it on",
                  "<head><script>var x;</script><link rel=x>"):
        assert main_text(f"{start}<article><h1>Headline</h1><p>{PROSE}</p></article>").split("\n")[-2:] == ["Headline", PROSE.strip()]
    assert main_text(f"<noscript><p>{PROSE}</p></noscript><article><p>One.</p></article>") == "One."


def test_names_of_comments_and_adverts_in_any_writing():
    names = """reader-comments user-comments comment-thread ad-slot ad-unit adsbygoogle sponsored-content cookieConsent siteFooter share-this
        related-content newsletter-cta commentsList side_bar-Sidebar""".split()
    for name in names:
        for page in (f"<article><h1>Headline</h1><p>{PROSE}</p><div class='{name}'><p>{PROSE}</p></div></article>",
                     f"<article><h1>Headline</h1><p>{PROSE}</p></article><div id='{name}'><p>{PROSE}</p><p>Yes</p></div>"):
            assert main_text(page) == f"Headline\n{PROSE.strip()}", name
    for name in ("no-sidebar", "has-ads", "related-work", "social-impact", "roads", "download", "shared-values"):
        assert main_text(f"<article><h1>Headline</h1><p>{PROSE}</p><div class='{name}'><p>{PROSE}</p></div></article>").count("cat sat") == 6, name


@pytest.mark.parametrize("page", [
    "<div>" * 40_000 + "x", "<div class=ad>" * 40_000 + f"<p>{'cat ' * 90}", "<a href=\"" * 20_000, "<p>" * 40_000, "<b>" * 20_000 + "</i>" * 20_000,
    "<i>" * 20_000 + "<li>" * 20_000, "<div><b>" * 20_000 + "<li>x" * 20_000, "</section>" * 40_000, "<!--" * 40_000, "<![" * 40_000, "<a x='" * 20_000,
    "<noscript><p>" * 20_000, "<script>" * 20_000, "<article>" * 20_000 + "<p>x" * 5000, "=" * 90_000 + "<p " + "=" * 90_000 + "/>", "<" * 90_000])
def test_time_follows_length(page):
    begin = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - begin < 3


def test_second_pass_asks_the_nearest_decided_blocks():
    assert second_pass(["good", "short", "good"], [False] * 3) == [True, True, True]
    assert second_pass(["bad", "near good", "bad"], [False] * 3) == [False] * 3
    assert second_pass(["good", "short", "short", "short", "bad"], [False] * 5) == [True, True, False, False, False]
    assert second_pass(["short", "near good"], [False] * 2) == [False, True]


def test_every_page_gets_a_row(spark, table):
    pages = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "v", "<p>" * 5000 + "x")], "page_id long, url string, html string") \
        .withColumn("text", F.lit("clash"))
    rows = extract(pages).collect()
    assert len(rows) == 3 and sorted(r.n_chars for r in rows)[:2] == [0, 0]
    assert extract(pages.limit(0)).count() == 0
    for r in extract(table("pages")).collect():
        assert r.n_chars == len(r.text) and "  " not in r.text and not r.text.startswith("\n")
