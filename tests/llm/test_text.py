"""Html, personal data, toxicity and chat against plain versions."""

import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import chat, html_extract, pii, toxicity
from vecloom.llm.common import read

from .helpers import ODD, docs, rows_of

# ---- html -----------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head>
<body class="home with-sidebar"><header class="site"><h1>Site</h1><nav><ul><li><a href="/x">Menu</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies</div><div class="ad-banner">Buy now {i}</div><aside>Side {i}</aside>
<div class="content with-sidebar"><article id="post-{i}"><header><h1>Title {i}</h1><p class="byline">by x</p></header>{body}<p>Thank you for reading this site.</p><div class="share">Share</div></article></div>
<form><label>Mail</label><input></form><section id="comments"><article><p>First! {i}</p></article></section><footer>&copy; site</footer></body></html>"""


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<p></p><br>", ""), ("just text &amp; more", "just text & more"),
        ("<p>a<b>b</b>c</p><p>d<br>e</p>", "abc d e"), ("<p>a &lt;b&gt; &#233;&#x41;&nbsp;x</p>", "a <b> éA x"),
        ("<body><nav>m</nav><p>kept<script>if(a<b){}</script> on</p><footer>f</footer>", "kept on"),
        ("<article><p>one<p>two <i>th</i>ree</article><p>out</p>", "one two three"), ("<main><ul><li>a<li>b</ul></main>", "a b"),
        ("<div class='comments'><article>c</article></div><article>t</article>", "t"), ("<article>cut <p>here <a href=", "cut here"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<div class='main-menu'>m</div><div id=content>c</div>", "c"), ("<!-- <p>x</p> --><p>y</p>", "y"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<table><tr><td>a</td><td>b</td></tr></table>", "a b"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page or "") == text


def test_paths_leave_out_the_rest():
    got = html_extract.main_text(PAGE.format(i=3, body="<p>Body &amp; soul.</p>"))
    assert got == "Title 3 Body & soul. Thank you for reading this site."


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><h2 id='related-work'>a</h2><p id='notice-periods'>b</p><h3 id=navigation>c</h3> <span class=share>d</span><section id='search-results'>e</section></article>", "a b c d e"),
        ("<div class='article-body promo-free'><p>whole</p></div>", "whole"), ("<div class='search-page'><article>a</article></div>", "a"),
        ("<div class='post-meta'>m</div><div><h1 class='post-title'>t</h1><p>text</p></div>", "m t text"),
        ("<div class='post-content'>c<div class='share-buttons'>s</div><div class='related-work'>w</div><ol class='comment-list'><li>k</ol></div><p>o</p>", "c w"),
        ("<article>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> be</article>", "Let x=2 be"),
        ("<main><div class='alert'>mind</div><div class=menu>n</div></main>", "mind"), ("<div data-id='ad'>x</div><div class='ad'>y</div>", "x"),
    ],
)
def test_names_take_no_article_text(page, text):
    """Only whole names of containers make something other than the article, or the article."""
    assert html_extract.main_text(page) == text


PAGES = "page_id long, url string, html string, host string, token string, constant string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def test_template_text_of_a_host_goes(spark):
    """What every page of a host says in one place is template; what pages of other hosts say is not."""
    rows = [(i, f"https://A.example/{i}", PAGE.format(i=i, body=f"<p>Story number {i}, told once.</p>")) for i in range(20)]
    rows += [(50 + i, "http://b.example/", PAGE.format(i=0, body="<p>Copied story.</p>")) for i in range(12)]
    rows += [(90, "http://c.example", PAGE.format(i=9, body="<p>Alone.</p>")), (91, None, None), (92, "x", ""), (93, None, "<p>no host</p>")]
    got = {r["page_id"]: r for r in html_extract.extract(pages(spark, rows).repartition(3)).collect()}
    for i in range(20):
        assert got[i]["text"] == f"Title {i} Story number {i}, told once."
        assert got[i]["n_chars"] == len(got[i]["text"])
    # Copies are no template.
    assert all(got[50 + i]["text"] == "Title 0 Copied story. Thank you for reading this site." for i in range(12))
    assert got[90]["text"] == "Title 9 Alone. Thank you for reading this site."
    assert (got[91]["text"], got[92]["text"], got[93]["text"]) == ("", "", "no host")


def test_template_text_inside_an_article_stays(spark):
    """Headings and sentences that every page of a host has are kept between texts of its own."""
    page = "<body><nav>n</nav><main><p>Welcome.</p><article><h2>Summary</h2><p>Dish {i}.</p><h2>Ingredients</h2><ul><li>{i} eggs</li></ul><p>Mix well.</p><p>Bake {i} minutes.</p><p>Bye.</p></article><article><p>Tip {i}</p><p>Bye.</p></article></main>"
    rows = [(i, f"https://a.example/{i}", page.format(i=i)) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows).repartition(3)).collect()}
    assert got == {i: f"Summary Dish {i}. Ingredients {i} eggs Mix well. Bake {i} minutes. Tip {i}" for i in range(20)}


BARE = """<html><body><div class="q1"><a href="/">Home page of all</a> <a href="/2">Second entry</a> {menu}</div><div class="q2"><span>Read this with care.</span></div>
<div class="q3"><h1>Tale {i}</h1><p>It was {i} o'clock.</p>{more}</div><div class="q4"><span>Printed by nobody.</span></div></body></html>"""


def bare_rows(n=30):
    """Pages whose markup says nothing: menus of links and fixed words around the text."""
    return [(i, f"https://bare.example/{i}", BARE.format(i=i, menu="or" if i % 3 else "", more="<p>And then more.</p>" * (i % 4))) for i in range(n)]


def test_the_template_finds_what_paths_do_not_name(spark):
    """Without the template the fixed words and the menu stay; with it they go."""
    rows = bare_rows()
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows).repartition(3)).collect()}
    want = {i: f"Tale {i} It was {i} o'clock." + " And then more." * (i % 4) for i, _, _ in rows}
    assert got == want
    alone = {i: html_extract.main_text(page) for i, _, page in rows}
    assert all(alone[i] != want[i] and "Printed by nobody." in alone[i] for i in want)


def test_templates_are_found_on_the_tables(spark):
    """Every host with pages enough has a template whose root holds the page's frame; the menu is among its slots."""
    from vecloom.llm.common import Scratch

    p = read(spark, "/root/testdata/sf0.01", "pages", "page_id", "url", "html")
    found = html_extract.deduce(p.select("url", "html"), Scratch(spark, "t")).collect()
    hosts = [h for (h,) in rows_of(p.groupBy(F.lower(F.regexp_extract("url", "//([^/?#:]*)", 1)).alias("h")).agg(F.count("*").alias("n")).where("n >= 6").select("h"))]
    assert found and len(found) >= 0.8 * len(hosts)
    tags = {html_extract.tag_token(t): t for t in ("/html", "/body", "/body/nav", "/body/article", "/body/article/h1", "/body/footer")}
    for r in found:
        assert [tags[t] for t in r["skeleton"] if t in tags] == list(tags.values())
        assert r["placed"] >= 2  # the frame, and the items of its menu


def test_classes_nest_in_gaps():
    """A class goes into the smallest gap that holds it; one that lies across a gap's ends belongs nowhere."""
    root, item, across, inner, tail = [0, 2, 10, 20], [3, 6], [8, 12], [4, 5], [21, 22]
    assert html_extract.nest([root, item, across, inner, tail]) == [(-1, 0), (0, 2), None, (1, 1), (0, 4)]


def test_pages_out_of_order_are_read_by_paths():
    order = [html_extract.tag_token(t) for t in ("/a1", "/b1", "/c1")]
    assert html_extract.follows(["/a1", "/x", "/b1", "/c1", "/a1"], order) and html_extract.follows(["/c1"], order)
    assert not html_extract.follows(["/b1", "/a1"], order)


def test_occurrence_vectors_against_brute_force(spark):
    """Fingerprints tell the vectors of counts apart: tokens of a host have equal ones exactly where their counts agree on all pages."""
    rows = bare_rows(12)
    found = [html_extract.page_tokens(page)[0] for _, _, page in rows]
    batch = pa.RecordBatch.from_pydict({"url": [u for _, u, _ in rows], "html": [h for _, _, h in rows]})
    out = next(html_extract._occurrences(iter([batch]))).to_pylist()
    prints = {(r["token"], r["kind"]): (r["f1"], r["f2"], r["pages"], r["times"]) for r in out if r["kind"] >= html_extract.TAG_KIND}
    vectors = {t: tuple(f.get(t, [0])[0] for f in found) for f in found for t in f}
    assert prints.keys() == vectors.keys()
    by_print, by_vector = ({frozenset(k for k in d if d[k] == v) for v in d.values()} for d in (prints, vectors))
    assert by_print == by_vector


def test_html_tables(spark, sf_dir):
    def plain(page):
        m = re.search(r"<article>(.*?)</article>", page, re.S)
        return " ".join(html.unescape(re.sub(r"<[^>]+>", lambda t: "" if re.match(r"</?b>", t.group()) else " ", m.group(1))).split())

    p = read(spark, sf_dir, "pages", "page_id", "url", "html")
    want = {r["page_id"]: plain(r["html"]) for r in p.collect()}
    assert {r["page_id"]: r["text"] for r in html_extract.extract(p).collect()} == want
    assert html_extract.extract(p.where("page_id < 0")).count() == 0


@given(st.text(alphabet="<>/\"'=!-abp &;\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_html_never_fails(page):
    text = html_extract.main_text(page)
    assert text == " ".join(text.split())


def test_long_broken_html():
    for page in ("<a " * 40_000, "<a \"" * 20_000, "&amp;" * 50_000, "<div>" * 20_000 + "x", "<!--" * 30_000, "</p>" * 50_000):
        html_extract.main_text(page)


# ---- personal data --------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    found = [(*m.span(), k) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m.group())]
    return sorted(found, key=lambda s: (s[0], list(BASE).index(s[2])))


@given(st.text(alphabet="a1@.+- (2_%x3)4é", max_size=40))
@settings(max_examples=2000, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_of_long_runs():
    for text in ("a" * 200_000, "1" * 100_000, "1." * 60_000, "+1" * 60_000, "a@" * 60_000, "a@b" * 50_000, "0" * 5000 + ".1.1.1"):
        pii.scan_text(text)
    assert pii.base_spans("0" * 5000 + ".1.1.1")[0][2] == "ip"


def test_pii_against_brute_force(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    want = {i: ",".join(f"{k}:{s}:{e}" for s, e, k in brute_spans(t)) for i, t in rows_of(d)}
    got = pii.query(spark, sf_dir).collect()
    assert {r["doc_id"]: r["base_sha256"] for r in got} == {i: hashlib.sha256(s.encode()).hexdigest() for i, s in want.items()}
    for r in got:
        assert set(want[r["doc_id"]].split(",")) <= set(r["spans"].split(",")) | {""}
        assert r["n_email"] == want[r["doc_id"]].count("email:")


def test_contexts_find_unseen_identifiers(spark):
    r = random.Random(1)
    number = lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
    rows = [(i, f"Some words {r.randrange(10**6)} before. Please call me at {number()} today or {r.choice('abcdefgh')}") for i in range(40)]
    rows += [(100, "Some words. Please call me at (722) 555-6978 today."), (101, "The year 2014 and code 99-12345 mean nothing."), *((200 + i, t) for i, (_, t) in enumerate(ODD))]
    got = {d: (b, s) for d, b, s in rows_of(pii.extract(docs(spark, rows, True).repartition(3)))}
    assert got[100][0] == [] and [(x["kind"], rows[40][1][x["start"] : x["stop"]].strip("( ")) for x in got[100][1]] == [("phone", "722) 555-6978")]
    assert got[101][1] == []
    assert all(got[200 + i][1] == [] for i in range(len(ODD)))
    assert pii.extract(docs(spark, rows).where("doc_id < 0")).count() == 0


def test_keys_need_a_sure_context(spark):
    """Strings like keys are seeds of the context they share; the context marks them and what else stands there, and nothing marks them elsewhere."""
    r = random.Random(2)
    key = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'{r.choice("abcdefg")} word {r.randrange(99)} token = "{key()}" {r.choice("hijk")}') for i in range(30)]
    rows += [(100, 'x token = "open-sesame" y'), (101, f"the build {key()} passed"), (102, 'a title = "open-sesame" b'), (103, "token = plain words")]
    got = {d: [rows[d if d < 30 else d - 70][1][x["start"] : x["stop"]] for x in s if x["kind"] == "secret"] for d, _, s in rows_of(pii.extract(docs(spark, rows).repartition(3)))}
    assert all(len(got[i]) == 1 and len(got[i][0]) == 40 for i in range(30))
    assert got[100] == ["open-sesame"] and got[101] == got[102] == got[103] == []


def test_patterns_are_scored_as_by_hand(spark):
    """The Spark scores against a plain walk over the same graph, with a pattern that holds most of the corpus."""
    r, rows = random.Random(3), []
    for i in range(300):
        kind = r.choice(["phone", "", "", "card"])
        rows.append((i, kind, f"n{r.randrange(120)}", r.choice(["p", "pc", "s"]) if not kind else {"phone": "p", "card": "c"}[kind], ["hot", r.choice(["a", "b", "c"])]))
    items = spark.createDataFrame([(*x[:1], 0, 1, *x[1:]) for x in rows], "row long, start long, stop long, kind string, instance string, shape string, patterns array<string>")
    from vecloom.llm.common import Scratch

    got = {(p, k): c for p, k, c in rows_of(pii.learn(items, Scratch(spark, "t"), 3, 0.3, 3))}
    edges = {}
    for _, kind, instance, shape, ps in rows:
        for p in ps:
            edges[p, instance, kind] = min(shape, edges.get((p, instance, kind), "z"))
    seeds = {(p, k): len({i for q, i, m in edges if q == p and m == k}) for p, _, k in edges if k}
    pairs = [(p, i, m, s, k) for (p, i, m), s in edges.items() for (q, k), n in seeds.items() if q == p and n >= 3]
    belief, score = {}, {}
    for _ in range(3):
        score = {}
        for p, i, m, s, k in pairs:
            own, against = m == k, m != k and (m != "" or k[0] not in s)
            t = score.setdefault((p, k), [0.0, 0.0, 0.0])
            t[0] += 1 if own else 0 if against else belief.get((i, k), 0)
            t[1] += against
            t[2] += 0 if own or against else 1 - belief.get((i, k), 0)
        score = {x: m / (m + a + pii.UNSEEN * u + 1) for x, (m, a, u) in score.items()}
        miss = {}
        for p, i, m, s, k in pairs:
            if m == "" and k[0] in s and score[p, k] >= pii.SPEAKS:
                miss[i, k] = miss.get((i, k), 1.0) * (1 - min(score[p, k], 0.999))
        belief = {x: 1 - v for x, v in miss.items()}
    assert got == pytest.approx({x: v for x, v in score.items() if v >= 0.3}) and len(got) > 2


def test_discoveries_on_the_tables(spark):
    found = pii.query(spark, "/root/testdata/sf0.1").agg(F.sum("n_found"), F.sum("n_secret"), F.sum(F.col("n_spans") - F.col("n_found") - F.col("n_email") - F.col("n_ip") - F.col("n_card") - F.col("n_phone"))).first()
    assert found[0] >= found[1] > 50 and found[2] == 0


# ---- toxicity -------------------------------------------------------------


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_grammar_reads_clauses():
    lex = toxicity.Lexicon(["idiot$", "vequ"])
    names = lambda t: {toxicity.EVENTS[i] for i, n in enumerate(lex.events(t)) if n}
    assert names("what an idiot.") == {"insult"}
    assert names("you are an idiot.") == {"insult aimed"}
    assert names("he is not an idiot.") == {"insult negated"}
    assert names("not so. idiot!") == {"insult"}
    assert names('They said "an idiot" wrote') == {"insult reported"}
    assert names("I will kill you, said none") >= {"threat"}
    assert names("you I will kill") == {"threat aimed"}
    assert names("idiotic vequille") == {"insult"}
    assert names("nothing here") == set() == names("")


def test_composition_is_the_steps_in_a_row():
    r = random.Random(0)
    for _ in range(200):
        states, single = toxicity.START, [0, 0, 0]
        for symbol in r.choices(toxicity.SYMBOLS, k=12):
            states, out = toxicity.GRAMMAR[states, symbol]
            want = symbol
            for i, step in enumerate((toxicity.negation, toxicity.reported, toxicity.aimed)):
                single[i], want = step(single[i], want)
            assert (list(states), out) == (single, want)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    own = read(spark, d, "documents", "doc_id", "text")
    model = toxicity.learn(own, read(spark, d, "labels", "doc_id", "toxic"))
    assert {"idiot$", "moron$"} <= set(model.entries) or any("idiot".startswith(e.rstrip("$")) for e in model.entries)
    found = toxicity.score(own, model).join(read(spark, d, "labels", "doc_id", "toxic"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [r["score"] for r in held if not r["toxic"]], [r["score"] for r in held if r["toxic"]]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert wins > 0.85
    assert sum(s >= 0.5 for s in good) <= 0.01 * len(good)


    # More toxic rows are caught than by any word of the lexicon being there, at no more false alarms than a hundredth.
    assert sum(s >= 0.5 for s in bad) >= 0.85 * len(bad)


CLAUSES = ["you are an idiot", "what an idiot", "he is not an idiot", "she said idiot to me", 'they wrote "an idiot and an idiot" again', "no idiot", "I will kill you", "you I kill", "never kill", "the sun is up", "he said not an idiot", "vequille"]


def brute_events(text, insults=("idiot",), stems=("vequ",)):
    """The grammar as sentences: each harmful word by what stands before it in its clause."""
    out = [0] * len(toxicity.EVENTS)
    for line in text.casefold().split("\n"):
        said, quoted = False, False
        for clause in re.split(r"([.!?;]+)", line):
            if re.fullmatch(r"[.!?;]+", clause):
                said = False
                continue
            since = {"negation": 99, "target": 99}
            for w in re.findall(r"[^\W\d_]+|\"", clause):
                kind = "insult" if w in insults or w.startswith(stems) else "threat" if w in toxicity.THREATS else None
                if kind:
                    how = "negated" if since["negation"] < 4 else "reported" if said or quoted else "aimed" if since["target"] < 4 else ""
                    out[toxicity.EVENTS.index(f"{kind} {how}".strip())] += 1
                since = {k: v + 1 for k, v in since.items()}
                if w in toxicity.NEGATIONS:
                    since["negation"] = 0
                elif w in toxicity.TARGETS:
                    since["target"] = 0
                elif w in toxicity.SPEECH:
                    said = said or not quoted
                elif w == '"':
                    said, quoted = False, said and not quoted
    return out


@given(st.lists(st.sampled_from([*CLAUSES, '"', "said", "not", "you", "idiot", "kill", "word"]), max_size=12), st.lists(st.sampled_from([". ", " ", "! ", "\n", "; "]), min_size=12, max_size=12))
@settings(max_examples=400, deadline=None)
def test_events_against_brute_force(parts, gaps):
    text = "".join(a + b for a, b in zip(parts, gaps, strict=False))
    assert toxicity.Lexicon(["idiot$", "vequ"]).events(text) == brute_events(text)


def test_scores_against_brute_force(spark):
    """Scores of texts from events counted by hand and the formula written out."""
    r = random.Random(6)
    model = toxicity.Model(["idiot$", "vequ"], np.array([-3.0, 0.7, 1.1]))
    rows = [(i, " ".join(r.choice(CLAUSES) + r.choice([".", "", "!", "\n"]) for _ in range(r.randrange(9)))) for i in range(60)] + ODD
    got = {(x["doc_id"], x["score"]): x["predicted"] for x in toxicity.score(docs(spark, rows, True).repartition(3), model).collect()}
    for i, t in rows:
        total = sum(n * w for n, w in zip(brute_events(t or ""), toxicity.PATHS, strict=True))
        z = -3.0 + 0.7 * np.log1p(total) + 1.1 * min(10.0, 100 * total / max(20, len((t or "").split())))
        score = next(s for d, s in got if d == i and s == pytest.approx(1 / (1 + np.exp(-z))))
        assert got[i, score] == int(score >= 0.5)


def test_context_lowers_scores():
    """Whatever the labels say, a negated or reported clause scores below a plain one, and an aimed one above."""
    x, y = np.array([[0.0, 0.0], [0.7, 5.0], [2.0, 9.0]] * 9), np.array([1.0, 0.0, 0.0] * 9)
    assert (toxicity.fit(x, y)[1:] >= 0).all()  # even where labels are against it
    score = toxicity.Model(["idiot$"], np.array([-3.0, 0.5, 1.0])).scorer()
    at = {c: score(c)[0] for c in CLAUSES}
    assert at["you are an idiot"] > at["what an idiot"] > at["she said idiot to me"] > at["he is not an idiot"] > at["the sun is up"]
    assert at["you I kill"] > at["I will kill you"] > at["never kill"] and at["he said not an idiot"] == at["he is not an idiot"]


def test_entries_are_not_told_twice():
    assert toxicity.choose([("idiot$", 9.0), ("idio", 9.0), ("idiots$", 5.0), ("veq", 4.0), ("vequ", 5.0), ("vequx", 3.0), ("vequa$", 2.0)]) == ["idiot$", "idiots$", "vequ"]


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    rows = [(i, "you idiot " + "abcdefghij"[i % 10] * 3 if i % 4 == 0 else "a fine day " + "klmnopqrst"[i % 10] * 4) for i in range(120)]
    truth = [(i, 1, int(i % 4 == 0)) for i, _ in rows]
    wrong = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in truth]
    d = docs(spark, rows)
    one, two = (toxicity.learn(d, labels(spark, x)) for x in (truth, wrong))
    assert (one.entries, one.weights) == (two.entries, two.weights)


def test_toxicity_edges(spark):
    d = docs(spark, ODD, True)
    none = toxicity.learn(d, labels(spark, []))
    assert none.entries == []
    got = toxicity.score(d, none).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in got)
    toxicity.learn(d, labels(spark, [(1, None, None), (None, 1, 1), (4, 1, 1), (4, 0, 0), (6, 1, 0)]))
    assert toxicity.score(d.where("doc_id < 0"), none).count() == 0
    kept = toxicity.keep_clean(d, none)
    assert kept.columns == d.columns and kept.count() == len(ODD)


# ---- chat -----------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, block string, node string, first string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TURNS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[x]", ""]), st.text(alphabet="</s>[INST]\\eolb rute", max_size=30)), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_template_round_trip(conversation):
    text = "".join(chat.turn_text(r, t, i == 0)[0] for i, (r, t) in enumerate(conversation))
    assert chat.parse(text) == conversation


def brute_digest(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, ts in by.items():
        ts = [x[2:] for x in sorted(ts)]
        loss = "".join(x for r, x in ts if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(ts), sha("".join(f"{r}\n{x}\n" for r, x in ts)), len(loss), sha(loss), 3 + sum(17 + len(chat.escape(r)) + len(chat.escape(x)) for r, x in ts)))
    return out


def chat_rows():
    r, rows = random.Random(6), []
    texts = ["hi", "", "</s>[INST] ok [/INST]", "\\l\\", "long " * 2000, "é𝒳"]
    for c in range(300):
        for t in range(r.randrange(1, 5)):
            rows.append((c, t, ["user", "assistant"][t % 2], texts[0] if t == 0 and c % 3 else r.choice(texts)))
    rows += [(900 + i, t, ["user", "assistant"][t], "same") for i in range(50) for t in range(2)]
    return rows + [(1000, None, None, None), (1000, 3, "user", "x"), (1000, 3, "user", "x"), (None, 1, "assistant", "no id"), (1001, 5, "assistant", None)]


@pytest.mark.parametrize("size", [512, 7])
def test_chat_against_brute_force(spark, size):
    """With blocks of seven the common first turn, and the common conversation, are split."""
    rows = chat_rows()
    assert sorted(rows_of(chat.digests(turns(spark, rows).repartition(3), size)), key=repr) == sorted(brute_digest(rows), key=repr)


def test_trees_share_turns(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"turn {t}" if t < 3 else f"own {c}") for c in range(5) for t in range(4)]
    nodes = chat.format_trees(turns(spark, rows)).orderBy("node").collect()
    assert len(nodes) == 3 + 5
    text = nodes[0]["text"]
    assert text.count("turn 2") == 1
    for n in nodes:
        spans = [(a["begin"], a["end"]) for a in n["ancestors"]]
        assert n["position"] == sum(e - b for b, e in spans)
        if n["leaf"]:
            assert len(chat.parse(chat.read_back(text, spans, n["begin"], n["end"]))) == 4
    begins = [n["begin"] for n in nodes]
    assert begins == sorted(begins) and nodes[-1]["end"] == len(text)
    assert chat.digests(turns(spark, rows).where("conv_id < 0")).count() == 0


def test_chat_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    cursor = c.execute(chat.ORACLE)
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, cursor.fetchall())) == sorted(rows_of(chat.query(spark, sf_dir).select(*names)))
