"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from one template.  A page is a sequence of tokens: tags
in the path that holds them, and text nodes.  A token's occurrence vector says
how often each page of the host has it; tokens with equal vectors form an
equivalence class.  Vectors are compared by fingerprints, sums over pages of a
hash of the page times the count, so they add up in any order, combine before
the shuffle and never bring a host's pages together.

Template: a class is valid when enough pages of the host hold it, a tag is in it,
its tokens have an order and it is as often on each page or, as the parts of
list items are, of several tags.  Valid classes are nested: the class of the page
as a whole, once on each page, is the root; another class belongs into the one
gap of a class already placed that holds all of it, the smallest there is, and
is dropped where no gap does.  What remains between the tokens of nested classes
are the slots.  Text of a placed class is template text.  A slot whose words are
mostly those of links, on most pages, is a menu.

Extraction: a page on which the root's tokens come in another order does not
follow the template and is read by paths alone.  On others the article's slot
goes from its first text that is not template text, or a heading ahead of that,
to its last, and all inside it is kept, a heading that every page has included.
Where paths name no article, all slots but menus are the main text, less
template text.

Path rules name the slots: an ``article`` or ``main`` (or a container named so
as a whole) holds the main text where a page has one; menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments of readers and
containers named so are left out.  Inside the article only whole class and role
names of containers count: no id, and no name of a heading, a paragraph or words
in one, takes text away.  Headings in a header inside the article belong to it.

Defined results: null, empty and tag-only html give an empty text.  A host seen
on fewer than ``min_pages`` pages, or whose pages mostly repeat one another,
gives no vectors to tell tokens apart by and is read by paths alone.  Urls
without a host share one.  Broken markup is read as far as it goes: an unclosed
tag at the end is dropped, an unclosed element ends with its parent.  A very
long page is one row, read once from end to end.  Repeated rows give repeated
results, an empty table none.  Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, join_known, read, texts

MIN_PAGES, MIN_SHARE, MIN_VARIETY = 6, 0.9, 0.5

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|(?=<)|\Z)", re.DOTALL)
NAMES = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mstyle mpadded menclose mfenced merror".split()
)
#: Not shown as text; an annotation repeats a formula in another notation.
RAW = frozenset("script style title textarea xmp noembed noframes iframe svg annotation annotation-xml template noscript".split())
NO_TEXT = frozenset("nav footer aside form button select option datalist dialog head menu object audio video canvas map".split())
OWN_KIND = frozenset("li dt dd tr td th option p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_NAMES = frozenset("main content article articlebody post entry story".split())
#: Tags that a name can make something other than the article; names of headings, paragraphs, items and words tell what their text is about.
CONTAINERS = frozenset("div section form fieldset details ul ol dl table header center".split())
#: Names of what is not the article.
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification "
    "newsletter subscribe subscription signup popup modal overlay breadcrumb breadcrumbs comment comments respond disqus reply replies related recommended "
    "recommendations share sharing social toolbar pagination pager login search teaser teasers outbrain taboola".split()
)
#: Names that may also say how the page around the article is laid out: an article inside one is still an article.
LAYOUT_NAMES = frozenset("sidebar header masthead menu nav navbar navigation footer widget widgets banner alert complementary contentinfo".split())
HEADER = frozenset({"header"})
#: Names of parts of a page that are no less the article for it: in an article a notice or an alert is a remark of its author.
REMARKS = frozenset("notice notices notification alert".split())
#: A copy of these is no article though its tag or another name says so.
NO_ARTICLE = frozenset("comment comments reply related teaser sponsored ad".split())
#: Parts of a name that add nothing to the others: "share-buttons" is a whole name for sharing, "promo-free" is none for promotion.
PLAIN_PARTS = frozenset(
    "area articles bar block body bottom box button buttons column container form group holder icon icons inner item items left link links list media outer "
    "panel placeholder post posts right row section slot stories text thread title top unit wrap wrapper".split()
)
#: The same for names of the article: "post-content" and "entry-body" are whole, "post-meta" and "post-title" are not.
PLAIN_MAIN = frozenset("area body column container inner outer page primary site text wrap wrapper".split())



class Text:
    """A text node: its path, the text, whether paths drop it, which article of the page it is in (0 for none), and how many tags come before it."""

    __slots__ = ("after", "dropped", "heading", "in_article", "link", "path", "text")

    def __init__(self, path: str, text: str, dropped: bool, in_article: int, link: bool, heading: bool, after: int):
        self.path, self.text, self.dropped, self.in_article, self.link, self.heading, self.after = path, text, dropped, in_article, link, heading, after

    @property
    def slot(self) -> str:
        """The path of the text; links count with what holds them."""
        return self.path.rpartition("/a")[0] if self.link else self.path


BREAK = None


def names_of(attributes: str) -> list[tuple[str, frozenset[str]]]:
    """The names an element goes by, each with its attribute and as its parts: ``class="main-menu wide"`` has {main, menu} and {wide}."""
    if not attributes or "=" not in attributes:
        return []
    return [(m.group(1).lower(), frozenset(p.lower() for p in PARTS.findall(name))) for m in NAMES.finditer(attributes) for name in (m.group(m.lastindex) or "").split()]


def whole(parts: frozenset[str], names: frozenset[str], plain: frozenset[str] = PLAIN_PARTS) -> bool:
    """Whether a name as a whole is one of ``names``, as "comment-list" is of {comment}."""
    return not parts.isdisjoint(names) and parts <= names | plain


def dropped_by_name(tag: str, apart: list[tuple[str, frozenset[str]]], main: bool, article: bool) -> int:
    """2 where an element's names say that it is not the article, 1 where an article inside it still is one, else 0.

    In an article only containers go, by whole class and role names.  Elsewhere
    containers go by ids too, and by parts of class and role names as layout;
    other tags by whole class and role names.
    """
    kinds = [parts for kind, parts in apart if kind != "id"]
    if main:
        return 2 if any(whole(parts, NO_ARTICLE) for parts in kinds) else 0
    others, layout = OTHER_NAMES, LAYOUT_NAMES - {"header"}
    if article:
        others, layout = others - REMARKS, layout - REMARKS
    if tag not in CONTAINERS:
        return 2 if not article and any(whole(parts, others) for parts in kinds) else 0
    tried = kinds if article else [parts for _, parts in apart]
    if any(whole(parts, others) for parts in tried):
        return 2
    if any(whole(parts, layout) for parts in tried):
        return 1
    return int(not article and any(not parts.isdisjoint(others | layout) for parts in kinds))


def parse(page: str) -> tuple[list[Text | None], list[str]]:
    """The text nodes in order, with BREAK where a block begins or ends, and the paths of all tags."""
    out: list[Text | None] = []
    tags: list[str] = []
    # Of each open element: its tag, path, dropped by rank (2 for good, 1 by layout), number of the article, in an article tag, in a header, in a heading, in a link.
    stack: list[tuple] = [("", "", 0, 0, False, False, False, False)]
    at = articles = 0

    def text(upto: int) -> None:
        if upto > at:
            raw = page[at:upto]
            if raw.isspace():
                out.append(Text("", " ", False, 0, False, False, len(tags)))
                return
            _, path, drop, article, _, header, heading, link = stack[-1]
            out.append(Text(path, html_lib.unescape(raw) if "&" in raw else raw, drop > 0 or header and not (article and heading), article, link, heading, len(tags)))

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        text(m.start())
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            out.append(BREAK)
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>]|$)", re.IGNORECASE).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else len(page)
            continue
        if tag not in INLINE:
            # A block ends an open paragraph; an item ends the item before it.
            for i in range(len(stack) - 1, max(0, len(stack) - 4), -1):
                if stack[i][0] == "p" or stack[i][0] == tag and tag in OWN_KIND:
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag == "body":
            del stack[1:]
        parent = stack[-1]
        apart = names_of(m.group(3))
        names = frozenset().union(*(parts for _, parts in apart))
        # A whole name makes a main text: "post-content" does, "post-meta" and "main-menu" do not.
        by_name = any(whole(parts, MAIN_NAMES, PLAIN_MAIN) for _, parts in apart)
        main = tag in MAIN_TAGS or by_name and tag not in INLINE and tag not in HEADINGS and tag not in ("html", "body", "p")
        drop, article, tagged, header = parent[2], parent[3], parent[4], parent[5]
        if main and drop == 1:
            drop = 0
        if tag not in ("html", "body"):
            drop = max(drop, 2 if tag in NO_TEXT else dropped_by_name(tag, apart, main, article > 0))
            if tag == "header" or tag in CONTAINERS and not main and any(whole(parts, HEADER) for kind, parts in apart if kind != "id" or not article):
                header = True
        path = f"{parent[1]}/{tag}" + ("." + ".".join(sorted(names)) if names else "")
        tags.append(path)
        if main and not article or tag == "article" and not tagged:
            # The articles of a main element are articles of their own.
            articles += 1
            article = articles
        stack.append((tag, path, drop, article, tagged or tag == "article", header and not (main and tag in MAIN_TAGS), parent[6] or tag in HEADINGS, parent[7] or tag == "a"))
    rest = page.find("<", at)
    text(len(page) if rest < 0 or not re.match(r"</?[a-zA-Z!?]", page[rest : rest + 3]) else rest)
    return out, tags


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def token(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def normal(text: str) -> str:
    return " ".join(text.split())


@lru_cache(1 << 16)
def tag_token(path: str) -> int:
    return token("tag", path)


@lru_cache(1 << 16)
def slot_token(path: str) -> int:
    return token("slot", path)


#: Kinds of tokens: a host as such, a page's main text, a tag, a text, and a path that holds text.
HOST, BODY, TAG_KIND, TEXT_KIND, SLOT_KIND = range(5)
SUMS = ("pages", "f1", "f2", "times", "place", "chars", "links")
OCCURRENCES = "host string, token long, kind int, pages long, f1 long, f2 long, times long, place double, chars long, links long"
OCCURRENCE = pa.schema([("host", pa.string()), ("token", pa.int64()), ("kind", pa.int32()), *((c, pa.float64() if c == "place" else pa.int64()) for c in SUMS)])


def page_tokens(page: str) -> tuple[dict[tuple[int, int], list], int]:
    """Of each token of a page: how often, where first, how many characters of text and of links; and a key of the page's main text."""
    nodes, tags = parse(page)
    found: dict[tuple[int, int], list] = {}
    for i, path in enumerate(tags):
        found.setdefault((tag_token(path), TAG_KIND), [0, i, 0, 0])[0] += 1
    body = []
    for node in nodes:
        if node is BREAK or not node.path:
            continue
        text = normal(node.text)
        found.setdefault((token("text", node.path, text), TEXT_KIND), [0, node.after - 0.5, 0, 0])[0] += 1
        slot = found.setdefault((slot_token(node.slot), SLOT_KIND), [0, node.after - 0.5, 0, 0])
        slot[0] += 1
        slot[2] += len(text)
        slot[3] += len(text) if node.link else 0
        if not node.dropped:
            body.append(text)
    return found, token("page", *body)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token occurrences of the pages of a batch, summed by host; the host itself as token 0, its distinct main texts as tokens of their own kind."""
    for batch in batches:
        sums: dict[tuple, list] = {}
        for url, page in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
            h = host(url)
            found, body = page_tokens(page)
            a, b = (token("f1", url, str(body)) & 0x3FFFFFFF, token("f2", url, str(body)) & 0x3FFFFFFF)
            for (t, kind), (n, place, chars, links) in [*found.items(), ((0, HOST), (1, 0, 0, 0)), *([((body, BODY), (1, 0, 0, 0))] if body else [])]:
                s = sums.setdefault((h, t, kind), [0, 0, 0, 0, 0.0, 0, 0])
                for i, v in enumerate((1, a * n, b * n, n, place, chars, links)):
                    s[i] += v
        keys = list(sums)
        yield pa.RecordBatch.from_pydict({"host": [k[0] for k in keys], "token": [k[1] for k in keys], "kind": [k[2] for k in keys]} | {c: [sums[k][i] for k in keys] for i, c in enumerate(SUMS)}, schema=OCCURRENCE)


def nest(classes: list[list[float]], repeated: frozenset[int] = frozenset()) -> list[tuple[int, int] | None]:
    """Where each class, given by the places of its tokens in order, belongs: (class, gap), (-1, 0) for the root, None where no gap holds all of it.

    The first class is the root; larger ones are placed before smaller ones.
    Places are those of first occurrences, so a class ``repeated`` on a page,
    which may hold tokens of the root in one occurrence and none in another, goes
    where its first token is.
    """
    out: list[tuple[int, int] | None] = []
    for i, places in enumerate(classes):
        if not i:
            out.append((-1, 0))
            continue
        home, width = None, float("inf")
        for j in range(i):
            if out[j] is None:
                continue
            ends = classes[j]
            gap = int(np.searchsorted(ends, places[0]))
            if i not in repeated and gap != int(np.searchsorted(ends, places[-1])) or not 0 < gap <= len(ends) - (j > 0):
                continue  # inside a class of parts only between two of them; the root's last gap is open
            size = (ends[gap] if gap < len(ends) else float("inf")) - ends[gap - 1]
            if home is None or size < width:
                home, width = (j, gap), size
        out.append(home)
    return out


TEMPLATE = "host string, constant array<long>, menus array<long>, skeleton array<long>, placed int"


def build_template(frame: pd.DataFrame) -> pd.DataFrame:
    """The template of one host from its frequent tokens, which are no more than a page has."""
    tokens = frame[frame["kind"] != SLOT_KIND].sort_values(["place", "kind", "token"], kind="stable")
    classes = []
    for _, c in tokens.groupby(["f1", "f2", "pages", "times"], sort=False):
        tags, whole = int((c["kind"] == TAG_KIND).sum()), int(c["times"].iloc[0]) % int(c["pages"].iloc[0]) == 0
        # As often on each page, or, as the parts of a list's items are, several tags that vary together.
        if tags and (whole or tags > 1) and c["place"].nunique() * 2 > len(c):
            classes.append(c)
    if not classes:
        return pd.DataFrame({"host": [], "constant": [], "menus": [], "skeleton": [], "placed": []})
    # The root: once on each page, as many of its tokens as there are. Then by size.
    classes.sort(key=lambda c: (int(c["times"].iloc[0]) != int(c["pages"].iloc[0]), -int(c["pages"].iloc[0]), -len(c), float(c["place"].iloc[0])))
    homes = nest([c["place"].tolist() for c in classes], frozenset(i for i, c in enumerate(classes) if int(c["times"].iloc[0]) > int(c["pages"].iloc[0])))
    placed = [c for c, home in zip(classes, homes, strict=True) if home is not None]
    constant = [int(t) for c in placed for t in c.loc[c["kind"] == TEXT_KIND, "token"]]
    root = classes[0]
    skeleton = root.loc[root["kind"] == TAG_KIND, "token"].tolist() if (root["times"] == root["pages"]).all() else []
    slots = frame[(frame["kind"] == SLOT_KIND) & (2 * frame["links"] >= frame["chars"]) & (frame["links"] > 0)]
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "constant": [constant], "menus": [slots["token"].tolist()], "skeleton": [skeleton], "placed": [len(placed)]})


def deduce(pages: DataFrame, scratch: Scratch, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_variety: float = MIN_VARIETY) -> DataFrame:
    """TEMPLATE of each host that has one: template texts, menus, the root's tags in order, and how many classes are placed.

    Hosts with few pages, or few different main texts, have none.
    """
    seen = pages.select("url", "html").mapInArrow(_occurrences, OCCURRENCES).groupBy("host", "token", "kind")
    seen = scratch.put(seen.agg(*(F.sum(c).alias(c) for c in SUMS)), "occurrences")
    hosts = seen.where(F.col("kind") == HOST).select("host", F.col("pages").alias("of"))
    variety = seen.where(F.col("kind") == BODY).groupBy("host").agg(F.count("*").alias("kinds"))
    hosts = hosts.where(F.col("of") >= min_pages).join(variety, "host").where(F.col("kinds") >= min_variety * F.col("of"))
    hosts = scratch.put(hosts, "hosts")
    tokens = join_known(seen.where((F.col("kind") >= TAG_KIND) & (F.col("pages") >= min_pages)), hosts, "host", hosts.count())
    tokens = tokens.where(F.col("pages") >= min_share * F.col("of")).withColumn("place", F.col("place") / F.col("pages"))
    return scratch.put(tokens.groupBy("host").applyInPandas(build_template, TEMPLATE), "templates")


def follows(tags: list[str], skeleton: list[int]) -> bool:
    """Whether the root's tags come on this page, each where it first does, in the template's order."""
    first: dict[int, int] = {}
    for i, path in enumerate(tags):
        first.setdefault(tag_token(path), i)
    at = [first[t] for t in skeleton if t in first]
    return all(a < b for a, b in zip(at, at[1:], strict=False))


def article_slots(nodes: list[Text | None], constant: frozenset[int]) -> dict[int, range]:
    """Of each article the nodes of its slot: from its first text that is no template text, or a heading of that, to the last such text."""
    slots: dict[int, range] = {}
    ahead: dict[int, int] = {}
    for i, x in enumerate(nodes):
        if x is BREAK or not x.path or x.dropped or not x.in_article:
            continue
        if token("text", x.path, normal(x.text)) not in constant:
            first = slots[x.in_article].start if x.in_article in slots else ahead.get(x.in_article, i)
            slots[x.in_article] = range(first, i + 1)
        elif x.heading:
            ahead.setdefault(x.in_article, i)
    return slots


NO_TEMPLATE: tuple[frozenset[int], frozenset[int], list[int]] = (frozenset(), frozenset(), [])


def main_text(page: str, template: tuple[frozenset[int], frozenset[int], list[int]] = NO_TEMPLATE) -> str:
    """The main text of a page, given its host's template: texts, menus and the root's tags in order."""
    nodes, tags = parse(page)
    constant, menus, skeleton = template
    if skeleton and not follows(tags, skeleton):
        constant, menus, skeleton = NO_TEMPLATE
    own = [x for x in nodes if x is not BREAK and x.path and not x.dropped]
    by_article = any(x.in_article for x in own)
    links = {}
    if not by_article:  # without an article, what is mostly links on this page is a menu, too
        for x in own:
            n = links.setdefault(x.slot, [0, 0])
            n[x.link] += len(x.text)
    slots = article_slots(nodes, constant) if constant and by_article else {}
    parts = []
    for i, x in enumerate(nodes):
        if x is BREAK:
            parts.append(" ")
        elif not x.path:
            # White space, or text outside every element, which counts on pages without an article.
            parts.append(x.text if x.text.isspace() or not by_article else "")
        elif x.dropped or by_article and not x.in_article:
            continue
        elif constant and i not in slots.get(x.in_article, ()) and token("text", x.path, normal(x.text)) in constant:
            continue
        elif not by_article and (slot_token(x.slot) in menus or x.link and links[x.slot][1] > 20 and links[x.slot][0] == 0):
            continue
        else:
            parts.append(x.text)
    return normal("".join(parts))


RESULT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
        found = [main_text(x, (frozenset(c or ()), frozenset(m or ()), k or [])) for x, (c, m, k) in zip(texts(batch.column(2)), known, strict=True)]
        yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(x) for x in found], pa.int64())})


def extract(pages: DataFrame, **settings) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    spark = pages.sparkSession
    bound_batches(spark, "8m")
    scratch = Scratch(spark, "html")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    templates = deduce(pages, scratch, **settings).drop("placed")
    size = templates.agg(F.count("*").alias("n"), F.sum(8 * (F.size("constant") + F.size("menus") + F.size("skeleton")) + F.length("host") + 64).alias("bytes")).first()
    key = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    known = join_known(pages.withColumn("host", key), templates, "host", size["n"], "left", size["bytes"] or 0)
    return known.select("page_id", "url", "html", "constant", "menus", "skeleton").mapInArrow(_extract, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


#: For tables whose pages all keep their text in one ``article`` with these few tags and character references.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]+>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM b)
SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS n_chars FROM c
"""
