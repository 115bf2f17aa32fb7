"""Main-text extraction by consensus host paths.

Each page's containers are scored by the text they hold; a page votes for the generalised tag-class path of its best one;
votes are summed per host in Spark; and every page is extracted again from all containers on its host's winning paths
(from its own best path where it has none of them).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.llm.common import boxed, unboxed, with_fields, written

#: A path wins on a host with this share of the votes of the host's first path, and is among so many.
SHARE = 0.1
WINNERS = 8
#: Steps of a path that are kept, from the innermost, and characters of a step.
DEPTH = 8
STEP = 200
#: Code points of a block that make it a paragraph of prose rather than a line of a form.
PARAGRAPH = 120

# Fixed word lists: kinds of elements, and names by which pages mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe template svg".split())
OPEN_RAW = frozenset("noscript template svg".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
DROP_TAGS = frozenset("head nav footer aside button select option dialog menu canvas object audio video map label datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body center".split())
DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner billboard "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars side rail aside footer foot bottom "
    "header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login register search comment comments commentlist reply replies respond disqus discussion "
    "share sharing social related recommended recommendations teaser teasers widget widgets pagination pager tags skip".split()
)
# Names that tell wherever they stand in a compound; beginnings and ends of compounds that state or sort something.
TELLING = frozenset("comments commentlist disqus advert adverts advertisement newsletter cookie cookies gdpr".split())
STATING = frozenset("has no with without is category cat tag type status format lang".split())
STATED = frozenset("open opened closed enabled disabled allowed".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
GOOD_NAMES = frozenset("article articlebody content post entry story main body text".split())
# What a start tag ends if it is open, and where the search for that stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

_OPEN = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
# A tag up to the > that is in no quoted value, and one up to the first >.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
# Matched one after the other, so that what stands in a value or is a part of a longer name is no attribute.
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_KNOWN = frozenset("class id role itemprop hidden style aria-hidden".split())
_WORD = re.compile(r"[a-z]+")
_END = {tag: re.compile(rf"</{tag}(?![a-z0-9-])", re.I) for tag in RAW}


def _attributes(text: str) -> dict[str, str]:
    """Those that matter, by name; of one that is given twice the first counts."""
    found: dict[str, str] = {}
    for name, v in _ATTRIBUTE.findall(text) if text else ():
        if (k := name.lower()) in _KNOWN:
            found.setdefault(k, unescape(v.strip("\"'")))
    return found


def _self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that is no part of an unquoted value."""
    last = 0
    for match in _ATTRIBUTE.finditer(attributes):
        last = match.end()
    return attributes.endswith("/") and last < len(attributes)


def _dropped(tag: str, at: dict[str, str], in_article: bool) -> bool:
    """Whether an element is no part of any article."""
    if tag in DROP_TAGS or tag == "header" and not in_article:
        return True
    if not at or tag in ("html", "body", "main"):
        return False
    if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return True
    if at.get("role", "").lower() in DROP_ROLES:
        return True
    for name in f"{at.get('class', '')} {at.get('id', '')}".split():
        words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        if not words or words[0] in STATING or words[-1] in STATED or "with" in words or "without" in words:
            continue
        if words[0] in DROP_NAMES or words[-1] in DROP_NAMES or not TELLING.isdisjoint(words):
            return True
    return False


def _step(tag: str, at: dict[str, str]) -> str:
    """A tag with its class names, sorted, numbers generalised; the id stands in where there is no class."""
    names = sorted(at.get("class", "").split()) or at.get("id", "").split()
    step = ".".join([tag, *(re.sub(r"\d+", "#", n.lower()) for n in names)])
    return step if len(step) <= STEP else f"{tag}.#{xxhash.xxh3_64_hexdigest(step)}"


class _Reader:
    """Tags and comments of a page in order, in time that grows with its length only.

    Once a tag has been met whose quotes never end, and so far as none of its ends can be found, all end at their first >.
    """

    def __init__(self, html: str) -> None:
        self.html, self.at, self.last = html, 0, html.rfind(">")
        self.loose = False
        self._without_end: set[str] = set()

    def next(self) -> tuple[str, bool, str, str] | None:
        """(text before it, whether it is an end tag, tag, attributes), or None if only text is left; comments have no tag."""
        html = self.html
        found = _OPEN.search(html, self.at)
        if not found:
            return None
        begin = found.start()
        before = html[self.at : begin]
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 2)
            self.at = end + 3 if end >= 0 else len(html)
            return before, False, "", ""
        if begin > self.last:
            return None
        if html[begin + 1] in "!?":
            self.at = html.find(">", begin) + 1
            return before, False, "", ""
        tag = None if self.loose else _TAG.match(html, begin)
        if tag is None:
            self.loose, tag = True, _LOOSE.match(html, begin)
        self.at = tag.end()
        return before, tag[1] != "", tag[2].lower(), tag[3]

    def skip(self, tag: str) -> bool:
        """Go behind the next end tag of ``tag``; False if there is none, and nothing is skipped."""
        end = None if tag in self._without_end else _END[tag].search(self.html, self.at)
        if end is None:
            self._without_end.add(tag)
            return False
        close = self.html.find(">", end.end())
        self.at = close + 1 if close >= 0 else len(self.html)
        return True


class Page:
    """One page, read once: its text blocks in order and the containers around them."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[str, int, int, int]] = []  # text, innermost container, characters in links, form
        self.parent, self.path, self.good_name, self.lost = [-1], [""], [False], [0]
        self._text: list[str] = []
        self._linked = 0
        self._holds_article = [False]  # of each form; 0 stands for none
        self._walk(html)
        self._settle_forms()

    def _walk(self, html: str) -> None:
        reader = _Reader(html)
        stack: list[tuple[str, int, int, int]] = []  # tag; container, depth of dropped elements and form outside it
        depths: dict[str, list[int]] = {}
        box = drop = form = 0

        def pop_to(depth: int) -> None:
            nonlocal box, drop, form
            while len(stack) > depth:
                tag, box, drop, form = stack.pop()
                depths[tag].pop()

        def innermost(tags: Iterable[str], stops: Iterable[str] = ()) -> int:
            """Depth of the innermost open element of ``tags``; -1 if there is none or one of ``stops`` is inside it."""
            at, stop = (max((d[-1] for t in names if (d := depths.get(t))), default=-1) for names in (tags, stops))
            return at if at > stop else -1

        def add(text: str) -> None:
            if not text:
                return
            if depths.get("head") and not text.isspace():
                pop_to(depths["head"][0])
            self._add(text, drop, bool(depths.get("a")), box)

        while (token := reader.next()) is not None:
            before, ends, tag, attributes = token
            add(before)
            if not tag:
                continue
            if ends:
                if tag in BLOCKS:
                    self._end_block(box, form)
                if (depth := innermost((tag,))) >= 0:
                    pop_to(depth)
                continue
            if tag == "svg" and _self_closed(attributes):
                continue
            if tag in RAW:
                if not reader.skip(tag) and tag not in OPEN_RAW:
                    reader.at = len(html)
                continue
            if tag not in HEAD_TAGS and depths.get("head"):
                pop_to(depths["head"][0])
            if tag in BLOCKS:
                self._end_block(box, form)
                if (depth := innermost(("p",), ("td", "th", "button"))) >= 0:
                    pop_to(depth)
            if tag in CLOSES and (depth := innermost(*CLOSES[tag])) >= 0:
                pop_to(depth)
            if tag == "br":
                add(" ")
            if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag != "a" or tag == "form" and depths.get("form"):
                continue
            in_article = bool(depths.get("article") or depths.get("main"))
            depths.setdefault(tag, []).append(len(stack))
            stack.append((tag, box, drop, form))
            known = _attributes(attributes)
            if drop or _dropped(tag, known, in_article):
                drop += 1
                continue
            if tag == "form":
                self._holds_article.append(False)
                form = len(self._holds_article) - 1
            elif tag in CONTAINERS:
                self.parent.append(box)
                self.path.append(">".join([*self.path[box].split(">")[1 - DEPTH :], _step(tag, known)]))
                names = set(_WORD.findall(f"{known.get('class', '')} {known.get('itemprop', '')}".lower()))
                self.good_name.append(tag in ("article", "main") or bool(names & GOOD_NAMES))
                self.lost.append(0)
                box = len(self.parent) - 1
            self._holds_article[form] |= tag in ("article", "main")
        add(html[reader.at :])
        self._end_block(box, form)

    def _add(self, text: str, drop: int, link: bool, box: int) -> None:
        if drop:
            self.lost[box] += len(text)
            return
        self._text.append(unescape(text) if "&" in text else text)
        if link:
            self._linked += len(text)

    def _end_block(self, box: int, form: int) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((text, box, self._linked, form))
            self._text, self._linked = [], 0

    def _settle_forms(self) -> None:
        """Drop the text of forms, but of those that pages are wrapped in: a form that holds the article, or over half of all
        text and a long paragraph, is a container like any other."""
        n = len(self._holds_article)
        if n == 1:
            return
        size, longest = [0] * n, [0] * n
        for text, _, _, form in self.blocks:
            size[form] += len(text)
            longest[form] = max(longest[form], len(text))
        keep = [f == 0 or self._holds_article[f] or 2 * size[f] > sum(size) and longest[f] >= PARAGRAPH for f in range(n)]
        for text, box, _, form in self.blocks:
            if not keep[form]:
                self.lost[box] += len(text)
        self.blocks = [b for b in self.blocks if keep[b[3]]]

    def scores(self) -> dict[str, float]:
        """Score of each path: text of its containers, less links and what is dropped inside them, named ones more."""
        n = len(self.parent)
        text, linked, lost = [0] * n, [0] * n, list(self.lost)
        for words, box, link, _ in self.blocks:
            text[box] += len(words)
            linked[box] += link
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            text[p], linked[p], lost[p] = text[p] + text[k], linked[p] + linked[k], lost[p] + lost[k]
        out: dict[str, float] = {}
        for k in range(n):
            if text[k]:
                worth = (text[k] - linked[k] - lost[k] / 4) * (1.2 if self.good_name[k] else 1.0)
                out[self.path[k]] = out.get(self.path[k], 0.0) + worth
        return out

    def best(self) -> tuple[str, float] | None:
        """The best path and its score, the deeper of equals."""
        s = self.scores()
        path = max(s, key=lambda p: (s[p], p.count(">"), p), default=None)
        return None if path is None else (path, s[path])

    def text(self, paths: list[str]) -> str:
        """Blocks, in page order, in the containers on those of ``paths`` that the page has text in, else on its own best path.

        Of paths of which one's containers enclose another's, the one that comes first decides.
        """
        held = [False] * len(self.parent)
        for _, box, _, _ in self.blocks:
            held[box] = True
        on: dict[str, list[int]] = {}
        for k in range(len(held) - 1, -1, -1):
            if held[k]:
                on.setdefault(self.path[k], []).append(k)
                held[self.parent[k]] |= k > 0
        chosen = [p for p in paths if p in on]
        if not chosen:
            best = self.best()
            chosen = [best[0]] if best else []
        inside, around = [False] * len(held), [False] * len(held)
        for path in chosen:
            if any(inside[k] or around[k] for k in on[path]):
                continue
            new = list(inside)
            for k in on[path]:
                new[k] = True
                up = self.parent[k]
                while up >= 0 and not around[up]:
                    around[up] = True
                    up = self.parent[up]
            for k in range(1, len(new)):
                new[k] |= new[self.parent[k]]
            inside = new
        return "\n\n".join(words for words, box, _, _ in self.blocks if inside[box])


def host(url: Column) -> Column:
    """The host of a url in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)), F.lit(""))


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, n): how many pages of a host have their best container on a path. Pages without a host do not vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            for name, html in zip(b.column(0), b.column(1)):
                if (h := name.as_py()) and (best := Page(html.as_py() or "").best()):
                    found[h, best[0]] = found.get((h, best[0]), 0) + 1
            rows = list(found.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64())],
                ["host", "path", "n"],
            )

    each = pages.select(host(F.col(url_col)).alias("u"), F.col(html_col).alias("h")).mapInArrow(run, "host string, path string, n long")
    return each.groupBy("host", "path").agg(F.sum("n").alias("n"))


def winners(voted: DataFrame, share: float = SHARE, most: int = WINNERS) -> DataFrame:
    """(host, paths): the paths of most votes, best first, each with at least ``share`` of the first one's votes."""
    # The rank is a limit of its own, so that each task sends on no more than ``most`` paths of a host, however many it has.
    ranked = voted.selectExpr("*", "row_number() OVER (PARTITION BY host ORDER BY n DESC, path) AS r").where(F.col("r") <= most)
    best = ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("r", "path", "n"))).alias("b"))
    chosen = F.filter("b", lambda x: x["n"] >= share * F.col("b")[0]["n"])
    return best.select("host", F.transform(chosen, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without ``html_col`` and with the main text ``name`` ('' if there is none).

    Null pages are empty; whole pages are read, however long, in time that grows with their length; a null or broken url has no host, and its page is read by its own best container; other columns
    and repeated rows stay; a column called ``name`` is replaced; an empty table gives no rows. Hosts' paths are a written
    table: the planner broadcasts it only if its size is under the session's limit, and joins by host otherwise.
    """
    paths = written(winners(votes(pages, url_col, html_col)), "html-paths").withColumnRenamed("host", "_host")
    sent = pages.select(boxed(pages, (name, html_col)), F.col(html_col).alias("_html"), host(F.col(url_col)).alias("_host"))
    schema = with_fields(sent.select("_row").schema, "_text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [Page(h.as_py() or "").text(w.as_py() or []) for h, w in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], schema.names)

    found = sent.join(paths, "_host", "left").select("_row", "_html", "paths").mapInArrow(run, schema)
    return unboxed(found, F.col("_text").alias(name))
