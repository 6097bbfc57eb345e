"""Operator 1: main text of HTML pages by consensus host paths.

Method: each page's containers are scored by the text of their blocks without links. A container's
path is the tags and classes from the root with digits generalised. Every page votes, in Spark, for
the path of its best container with that container's share of the page's text; a host's winning
paths are those with at least SUPPORT of its strongest path's votes. Each page is then extracted
again by the first winning path that it has and that holds at least AGREE of the text of its own
best path, else by its own best. The text is that of all containers with the path, in page order.

A best container inside an article or main element gives way to that element, if what this adds has
text, and no more text in links than other text; and so it does to a container named as content that
holds further parts, if these have no more text than it and at most half of that again in links.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out by tag, role and class names. A header inside the article that has a heading stays, and so
do paragraphs, headings and the like there, unless named as an advert, promotion or cookie notice.
Words that also name parts of articles (WEAK_WORDS: "social-history") count there only alone or with
words of pages ("social-icons"), else only if half of the element's text is links; a discussion stays
if it is a section or has that heading. A form outside any article that holds an article, or prose and half of the page's text, is a wrapper.

Null or empty html: empty text. A page without any container: the text of its body. Null url: the
page votes and is judged as of an empty host. Equal votes: the smaller path. Repeated rows: each is
extracted and votes. Very long pages are read whole. Extra columns are dropped.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Share of a host's votes that a winning path needs; so a host has 1 / SUPPORT of them at most.
SUPPORT = 0.05
AGREE = 0.5
#: A host's pages are dealt over a key for each such part of all pages; so fewer hosts than this are dealt at all.
SLICES = 100_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article body div main section td table center details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag ends, and what it doesn't look beyond.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: An end tag of an inline element or paragraph doesn't look beyond these.
LIMITS = CONTAINERS | {"tr", "table", "li", "ul", "ol"}
#: Left out with all that they hold.
DROP = frozenset("head script style noscript template nav footer aside button select option textarea input iframe svg canvas object embed dialog menu title noembed noframes datalist audio video map".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
#: Class and id words of what isn't the article.
DROP_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising advertorial adsense sponsor sponsored sponsors promo promos
promotion nav navbar navigation menu menus submenu sidebar sidebars sidenav rail footer foot masthead topbar breadcrumb breadcrumbs
crumbs cookie cookies consent gdpr notice notices alert alerts notification notifications popup modal overlay newsletter subscribe
subscription signup login share sharing shares social comment comments commentlist respond disqus reply replies discussion
related recommended recommendation recommendations popular trending pager pagination paginator toolbar widget widgets
skip banner banners paywall disclaimer copyright tags tagcloud byline-share feedback search searchbox""".split())
#: Of these, the ones that also name parts of articles ("social-history"). Inside an article a name made of one of them and
#: words that aren't of PAGE_WORDS leaves an element out only if half of its text is links.
WEAK_WORDS = frozenset("""alert alerts banner banners copyright disclaimer discussion feedback foot menu modal notice notices notification
notifications overlay pager popular popup promotion rail related recommended recommendation recommendations search searchbox share shares
sharing skip social tagcloud tags toolbar trending widget widgets""".split())
PAGE_WORDS = frozenset("""area article articles bar block body bottom box btn button buttons col column container content desktop form group
header icon icons info inner item items left link links list main message mobile module outer panel post posts right row section success
text title toggle top warning wrap wrapper""".split())
#: A container named so isn't one text with several parts.
WRAPPER_WORDS = frozenset("wrap wrapper container page site layout outer row cols columns grid".split())
#: Inside an article, elements of prose are left out only by these.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dl dt dd figure figcaption".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos cookie cookies consent gdpr newsletter".split())
#: Words that mark a page's head only as a whole.
DROP_NAMES = frozenset("header site-header page-header siteheader pageheader global-header top-header side-bar site-footer page-footer side-column related-posts read-more see-also back-to-top user-comments reader-comments".split())
GOOD_WORDS = frozenset("article articlebody body content contents entry hentry main mainbody post postbody story text prose".split())

#: A quote opens a value only behind an equals sign; one that isn't closed reaches to the end, as in browsers.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass(slots=True)
class Node:
    tag: str
    path: int = 0  # number in the page's Paths
    good: bool = False
    joins: bool = False  # one text, should its parts be containers of their own
    weak: str = ""  # in an article and named as what may not belong to it: the words
    whole: bool = False  # an article or main element, or one in the role of it
    link: bool = False
    inside: bool = False  # in an element that is whole
    parts: list = field(default_factory=list)  # texts and nodes in order
    text: int = 0  # characters of its own and its inline children's text that are in no link


class Paths:
    """Numbers of a page's paths: a path is the one of its parent and a step, so that deep pages don't repeat them."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(0, "")]

    def number(self, parent: int, step: str) -> int:
        found = self.numbers.setdefault((parent, step), len(self.steps))
        if found == len(self.steps):
            self.steps.append((parent, step))
        return found

    def text(self, number: int) -> str:
        out = []
        while number:
            number, step = self.steps[number]
            out.append(step)
        return "".join(f">{step}" for step in reversed(out))

    def find(self, path: str) -> int | None:
        """The number of a path as text; None if the page hasn't got it."""
        number: int | None = 0
        for step in path.split(">")[1:]:
            number = self.numbers.get((number, step))
            if number is None:
                break
        return number


def words_of(value: str, parts: bool = True) -> list[str]:
    """Class or id names, whole and in parts, in lower case."""
    out = []
    for name in value.split():
        name = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()
        out.append(name)
        if parts and ("-" in name or "_" in name) and not name.startswith(("with-", "has-", "no-", "without-", "not-", "is-")):
            out += re.split(r"[-_]+", name)
    return out


def generalised(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes, digits generalised; numbered classes of one kind are one."""
    classes = sorted({re.sub(r"\d+", "0", c).replace(">", "&gt;") for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def left_out(tag: str, attributes: dict[str, str], inside: bool = False) -> bool:
    if tag in DROP or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in DROP_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    names = words_of(attributes.get("class", "")) + words_of(attributes.get("id", ""))
    if inside and tag in PROSE:
        return any(n in ADVERT_WORDS for n in names)
    if inside:
        strong = any(n in DROP_NAMES or (n in DROP_WORDS and n not in WEAK_WORDS) for n in names)
        return strong or any(of_the_page(n) for n in words_of(attributes.get("class", "") + " " + attributes.get("id", ""), parts=False))
    return any(n in DROP_NAMES or n in DROP_WORDS for n in names)


def of_the_page(name: str) -> bool:
    """Whether a name has one of WEAK_WORDS and otherwise only words of pages, none of a text's own."""
    parts = set(re.split("[-_]+", name))
    return not parts.isdisjoint(WEAK_WORDS) and name != "discussion" and parts <= WEAK_WORDS | PAGE_WORDS | DROP_WORDS


def weak_names(attributes: dict[str, str]) -> str:
    return " ".join(n for n in words_of(attributes.get("class", "")) + words_of(attributes.get("id", "")) if n in WEAK_WORDS)


class Stack:
    """Open elements, and by tag where they are, so that nothing has to be looked for from the top."""

    def __init__(self, root: Node):
        self.tags = ["#root"]
        self.nodes: list[Node | None] = [root]  # None: inside something left out
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]  # of elements that aren't inline

    def push(self, tag: str, node: Node | None) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def close_to(self, k: int) -> None:
        for tag in self.tags[k:]:
            self.places[tag].pop()
        while self.blocks[-1] >= k:
            self.blocks.pop()
        del self.tags[k:], self.nodes[k:]

    def last(self, tags) -> int:
        """The innermost of these tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end(self, tag: str) -> None:
        """An end tag: closes its element unless that lies beyond a limit; without one it does nothing."""
        k = self.last((tag,))
        if k and (k > self.last(LIMITS) if tag in INLINE or tag == "p" else True):
            self.close_to(k)

    def start(self, tag: str) -> None:
        """What a start tag closes."""
        if tag in CLOSES_P and self.tags[self.blocks[-1]] == "p":
            self.close_to(self.blocks[-1])
        if tag in ENDS:
            ended, scope = ENDS[tag]
            limit = self.last(scope)
            if tag not in ("tr", "tbody"):
                k = self.last(ended)
            else:
                k = min((at[i] for at in (self.places.get(t, ()) for t in ended) if (i := bisect.bisect_right(at, limit)) < len(at)), default=0)
            if k > limit:
                self.close_to(k)


def parse(text: str, paths: Paths) -> Node:
    """Tree of the page without what is left out; unclosed and stray tags are handled as browsers do."""
    root = Node("#root")
    stack = Stack(root)
    at = 0
    forms = weak_ones = False

    def add(piece: str) -> None:
        top = stack.nodes[-1]
        if top is not None and piece:
            top.parts.append(piece)

    while True:
        low = text.find("<", at)
        if low < 0:
            add(text[at:])
            break
        m = TAG.match(text, low)
        if not m:
            add(text[at : low + 1])
            at = low + 1
            continue
        add(text[at:low])
        at = m.end()
        if m[3] is None:
            if m[1]:
                add(entities.escape(m[1]))
            continue
        tag = m[3].lower()
        if m[2]:
            stack.end(tag)
            continue
        stack.start(tag)
        forms = forms or tag == "form"
        parent = stack.nodes[-1]
        attributes = {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m[4])} if m[4].strip(" /") else {}
        if tag in VOID:
            if parent is not None and tag in ("br", "hr"):
                parent.parts.append(Node(tag))
            continue
        node = None
        inside = parent is not None and (parent.inside or parent.whole)
        if parent is not None and not (tag == "form" and inside) and not left_out(tag, attributes, inside):
            node = Node(tag, paths.number(parent.path, generalised(tag, attributes)) if tag not in INLINE else parent.path)
            names = words_of(attributes.get("class", "")) + words_of(attributes.get("id", ""))
            node.whole = tag in ("article", "main") or (tag in CONTAINERS and (attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody"))
            node.good = node.whole or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody" or any(w in GOOD_WORDS for w in names)
            node.joins = node.good and tag in ("div", "section") and not any(w in WRAPPER_WORDS for w in names)
            node.link = tag == "a" or parent.link
            node.inside = inside
            if inside and tag not in PROSE:
                node.weak = weak_names(attributes)
                weak_ones = weak_ones or bool(node.weak)
            parent.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(text, at)
            at = end.start() if end else len(text)
        if not m[4].endswith("/") or tag not in ("svg", "path"):
            stack.push(tag, node)
    prune_headers(root, False)
    if forms:
        prune_forms(root)
    if weak_ones:
        prune_weak(root)
    return root


def prune_weak(root: Node) -> None:
    """Leaves out weakly named parts of articles of which half is links, and a discussion that is no section and has no such heading."""
    order, pending = [], [root]
    while pending:
        one = pending.pop()
        order.append(one)
        pending += [c for c in one.parts if not isinstance(c, str)]
    text: dict[int, int] = {}
    links: dict[int, int] = {}
    for one in reversed(order):
        inner = [c for c in one.parts if not isinstance(c, str)]
        own = sum(len(c.strip()) for c in one.parts if isinstance(c, str))
        text[id(one)] = (0 if one.link else own) + sum(text[id(c)] for c in inner)
        links[id(one)] = (own if one.link else 0) + sum(links[id(c)] for c in inner)

    def titled(node: Node) -> bool:
        inner = [c for c in node.parts if not isinstance(c, str)]
        return any(c.tag in HEADINGS and re.fullmatch(r"[\d.\s]*discussion(?:\s.*)?", " ".join(blocks(c)), re.I | re.S) for c in inner)

    def stays(node: Node) -> bool:
        if not node.weak or node.inside is False:
            return True
        if links[id(node)] >= text[id(node)]:
            return False
        return "discussion" not in node.weak.split() or node.tag == "section" or titled(node)

    for one in order:
        one.parts = [c for c in one.parts if isinstance(c, str) or stays(c)]


def prune_forms(root: Node) -> None:
    """Leaves out forms, except those that wrap an article, or prose and half of the page's text."""
    order, pending = [], [root]
    while pending:
        one = pending.pop()
        order.append(one)
        pending += [c for c in one.parts if not isinstance(c, str)]
    size: dict[int, int] = {}
    kinds: dict[int, int] = {}  # 1: has an article or main element, 2: prose
    for one in reversed(order):
        inner = [c for c in one.parts if not isinstance(c, str)]
        size[id(one)] = sum(len(c.strip()) for c in one.parts if isinstance(c, str)) + sum(size[id(c)] for c in inner)
        kinds[id(one)] = (1 if one.whole else 0) | (2 if one.tag == "p" else 0)
        for c in inner:
            kinds[id(one)] |= kinds[id(c)]
    for one in order:
        one.parts = [c for c in one.parts if isinstance(c, str) or c.tag != "form" or kinds[id(c)] & 1 or (kinds[id(c)] and 2 * size[id(c)] >= size[id(root)])]


def prune_headers(node: Node, inside: bool) -> bool:
    """Leaves out header elements, except those inside an article that have a heading. True if there is a heading."""
    pending = [(node, inside, False)]
    order = []
    while pending:  # no recursion: markup may be nested deeply
        one, within, _ = pending.pop()
        order.append((one, within))
        pending += [(c, within or one.tag in ("article", "main"), False) for c in one.parts if not isinstance(c, str)]
    heading: dict[int, bool] = {}
    for one, _ in reversed(order):
        heading[id(one)] = one.tag in HEADINGS or any(heading[id(c)] for c in one.parts if not isinstance(c, str))
    for one, within in order:
        here = within or one.tag in ("article", "main")
        one.parts = [c for c in one.parts if isinstance(c, str) or c.tag != "header" or (here and heading[id(c)])]
    return heading[id(node)]


def blocks(node: Node) -> list[str]:
    """Texts of the blocks in page order: references decoded, white space made one blank, trimmed, empty ones left out."""
    out: list[str] = []
    current: list[str] = []

    def end() -> None:
        if current:
            text = " ".join("".join(current).split())
            if text:
                out.append(text)
            current.clear()

    pending: list = [node]
    while pending:
        one = pending.pop()
        if one is None:
            end()
        elif isinstance(one, str):
            current.append(entities.unescape(one))
        elif one.tag == "br":
            current.append(" ")
        elif one.tag in INLINE:
            pending += reversed(one.parts)
        else:
            end()
            pending.append(None)
            pending += reversed(one.parts)
    end()
    return out


@dataclass(slots=True)
class Candidate:
    score: float
    text: int  # characters outside links
    linked: int  # characters in links
    node: Node
    outer: Candidate | None  # the container around it


def candidates(root: Node) -> list[Candidate]:
    """Every container in page order; the score favours the innermost that holds nearly all the text."""
    order: list[tuple[Node, Node | None]] = []
    pending: list[tuple[Node, Node | None]] = [(root, None)]
    while pending:
        one, outer = pending.pop()
        order.append((one, outer))
        around = one if one.tag in CONTAINERS or one.tag == "#root" else outer
        pending += [(c, around) for c in reversed(one.parts) if not isinstance(c, str)]
    total: dict[int, int] = {}
    linked: dict[int, int] = {}
    own: dict[int, float] = {}
    for one, _ in reversed(order):
        text, links, near = 0, 0, 0.0
        for part in one.parts:
            if isinstance(part, str):
                if one.link:
                    links += len(part.strip())
                else:
                    text += len(part.strip())
            else:
                text += total[id(part)]
                links += linked[id(part)]
                near += own[id(part)] if part.tag not in CONTAINERS else 0.4 * own[id(part)]
        total[id(one)], linked[id(one)] = text, links
        if one.tag in CONTAINERS or one.tag == "#root":
            direct = sum(len(p.strip()) for p in one.parts if isinstance(p, str) and not one.link)
            own[id(one)] = near + direct
        else:
            own[id(one)] = float(text) if not any(not isinstance(p, str) and p.tag in CONTAINERS for p in one.parts) else near
    found: dict[int, Candidate] = {}
    for one, outer in order:
        if one.tag in CONTAINERS or one.tag == "#root":
            weight = {"article": 2.0, "main": 1.6, "body": 0.8, "#root": 0.7}.get(one.tag, 1.0) * (1.4 if one.good and one.tag not in ("article", "main") else 1.0)
            found[id(one)] = Candidate(own[id(one)] * weight, total[id(one)], linked[id(one)], one, found[id(outer)] if outer else None)
    return list(found.values())


def best(all_: list[Candidate]) -> Candidate:
    """The container with the highest score, of equal ones the first in the page, or the article or main element around it,
    or a container named as an article around it and its sibling parts."""
    one = max(all_, key=lambda c: c.score)
    around = one.outer
    while around:
        more, links = around.text - one.text, around.linked - one.linked
        if more > 0 and ((around.node.whole and more >= links) or (around.node.joins and more >= 2 * links and more <= one.text)):
            one = around
        around = around.outer
    return one


def along(all_: list[Candidate], path: int | None) -> tuple[list[Candidate], int]:
    """The containers with a path, in page order, and the characters of their text. One path has one depth, so none holds another."""
    same = [c for c in all_ if c.node.path == path]
    return same, sum(c.text for c in same)


def host_of() -> F.Column:
    """Host of the url in lower case, without port and user; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, path and vote of each page's best path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, shares = [], []
            for page in batch.column("html").to_pylist():
                known = Paths()
                all_ = candidates(parse(page or "", known))
                path = best(all_).node.path
                whole = max(c.text for c in all_)
                paths.append(known.text(path))
                shares.append(along(all_, path)[1] / whole if whole else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], names=["host", "path", "vote"])

    return pages.select(host_of().alias("host"), "html").mapInArrow(run, "host string, path string, vote double")


def winners(found: DataFrame) -> DataFrame:
    """host, its pages and its winning paths, the strongest first. Votes are summed before anything is gathered per host."""
    by_path = found.groupBy("host", "path").agg(F.sum(F.round("vote", 6).cast("decimal(20,6)")).alias("votes"), F.count("*").alias("pages"))
    by_path = common.cut(by_path, "votes")  # else the pages are parsed for both of its uses
    top = by_path.groupBy("host").agg(F.sum("votes").alias("all_votes"), F.sum("pages").alias("n_pages"))
    strong = by_path.join(top, "host").where((F.col("votes") > 0) & (F.col("votes") >= F.col("all_votes") * SUPPORT))
    kept = strong.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path"))).alias("all"), F.first("n_pages").alias("n_pages"))
    return kept.select("host", "n_pages", F.transform("all", lambda s: s["path"]).alias("paths"))


def text_by(page: str | None, paths: list[str] | None) -> tuple[str, str]:
    """Main text of one page by its host's winning paths, and the path that was used."""
    if not page:
        return "", ""
    known = Paths()
    all_ = candidates(parse(page, known))
    own = best(all_).node.path
    same, most = along(all_, own)
    used = known.text(own)
    for path in paths or ():
        voted, text = along(all_, known.find(path))
        if text and text >= AGREE * most:
            same, used = voted, path
            break
    return " ".join(b for c in same for b in blocks(c.node)), used


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used, of every page."""
    by_host = common.cut(winners(votes(pages)), "host-paths")
    # a host's pages are dealt over as many keys as it has slices, should the paths be too many for a broadcast
    total = by_host.agg(F.sum("n_pages")).first()[0] or 0
    sliced = by_host.withColumn("salts", F.ceil(F.col("n_pages") * SLICES / F.lit(max(total, 1))))
    large = sliced.where("salts > 1").select("host", "salts")
    dealt = pages.select("page_id", "url", "html", host_of().alias("host")).join(F.broadcast(large), "host", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("url", "page_id"), F.col("salts"))).otherwise(F.lit(0)))
    joined = dealt.join(sliced.select("host", "paths", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")), ["host", "salt"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_by(page, paths) for page, paths in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array([m[0] for m in made], pa.string()), pa.array([len(m[0]) for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "path"])

    return joined.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, path string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
