"""Main text of web pages by composite text density.

Every DOM node gets characters per tag, adjusted for links: with C characters
and T tags in its subtree, LC and LT of them in links, and body totals Cb, LCb,

    density = C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

(zero denominators count as one; the logarithms are at least 1 and ``LEAST_LOG``,
as they vanish for one character and on a page without links). A node's density sum is that of its children.
The node with the greatest sum is content; the least density on its path to
the body is the threshold, and in every branch whose density reaches it the
subtree with the greatest sum is content too, as are headings beside content.
Plain formatting elements are no nodes; their text is that of the element
around them. Where the content lies in an article or main element, all of that
element is content, and so are later sections like it: elements of the same tag
and class beside it that are not mostly links.

Navigation, adverts, forms and the like are taken out first: by element, role
and hidden state for good, by class and id as far as they go. A name that is all
of a class ("comments") rules a node out unless it holds the page's main or h1
element or nearly all of its text; a name that is part of one ("no-sidebar",
"legal-guide") rules it out unless it holds half of the text, and
modifiers ("has-banner", "comments-open") do not rule anything out.

Markup is read as HTML says: declarations and sections that it does not know
are comments, and a tag or comment that the page never ends is dropped with it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

LEAST_LOG = 0.5

# Elements of HTML and names by which pages mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE = frozenset("aside button canvas dialog footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMES = (
    r"(?:ads?|adverts?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner|side-?bar|nav(?:bar|igation)?|menu|"
    r"breadcrumbs?|footer|site-?header|page-?header|top-?bar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"subscri[a-z]+|newsletter|sign-?up|log-?in|comments?|comment-?list|disqus|repl(?:y|ies)|responses|related|"
    r"recommend[a-z]*|share|sharing|social|widget|toolbar|pagination|pager|tags|legal|copyright|skip)"
)
STRONG_NAMES = re.compile(rf"(?:^|\s){_NAMES}\d*(?:$|\s)", re.I)
WEAK_NAMES = re.compile(rf"(?:^|[\s_-]){_NAMES}(?:$|[\s_\d-])", re.I)
MODIFIERS = re.compile(
    rf"(?<!\S)(?:(?:no|has|with|without|is|show|hide)[_-]+[\w-]*|{_NAMES}[_-]+(?:open|opened|closed|enabled|disabled|on|off|active|inactive))(?!\S)", re.I
)
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
MOST, NEARLY_ALL = 0.5, 0.9  # of a page's text, from which a name does not rule a node out
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = BLOCK - {"body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Page(HTMLParser):
    """The nodes of a page in order (tag, parent, class, noise, kind of name), and its text as (node, block, data)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.noise, self.text = ["#root"], [-1], [False], []
        self.named, self.kind = [""], [""]
        self.open, self.block, self.breaks = [0], 0, 0
        self.places: dict[str, list[int]] = {}  # where in ``open`` the elements of a tag are

    # Declarations, as HTML reads them: whatever is not known is a comment up to the next ">".
    def parse_comment(self, i: int, report: int = 1) -> int:
        if self.rawdata.startswith(("<!-->", "<!--->"), i):
            return self.rawdata.index(">", i) + 1
        end = re.compile(r"--!?>").search(self.rawdata, i + 4)
        return end.end() if end else -1

    def parse_html_declaration(self, i: int) -> int:
        data = self.rawdata
        if data.startswith("<!--", i):
            return self.parse_comment(i)
        end = data.find(">", i + 2)
        if data[i : i + 9].lower() == "<!doctype" and 0 <= data.find("[", i) < end:  # an internal subset goes with it
            subset = re.compile(r"\]\s*>").search(data, i)
            end = subset.end() - 1 if subset else end
        return end + 1 if end >= 0 else -1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def close(self) -> None:
        if re.match(r"<[!?/a-zA-Z]", self.rawdata):  # what the page never ends
            self.rawdata = ""
        super().close()

    def _push(self, at: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(at)

    def _cut(self, k: int) -> None:
        for i in range(len(self.open) - 1, k - 1, -1):
            self.places[self.tag[self.open[i]]].pop()
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, within={"article", "button", "td", "th", "table", "blockquote", "section", "div", "li"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], within={"ul", "ol", "dl", "table", "select"})
        self.breaks = self.breaks + 1 if tag == "br" else 0
        if tag in BLOCK or self.breaks == 2:
            self.block += 1
        if tag == "br":
            self.handle_data(" ")
        named = dict(attrs)
        if tag in INLINE and not any(named.get(a) for a in ("class", "id", "role")) and not self._is_noise(tag, named):
            return
        at, up = len(self.tag), self.open[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.named.append(f"{tag} {named.get('class') or ''}")
        self.noise.append(self.noise[up] or self._is_noise(tag, named))
        self.kind.append(self._kind(tag, named))
        if tag not in VOID:
            self._push(at, tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.tag[self.open[-1]] == tag and tag in ("svg", "path", "use"):
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE and self.tag[self.open[-1]] != tag:
            return
        self._close({tag}, within=set() if tag in BLOCK else {"article", "section", "div", "td", "li", "p"})

    def handle_data(self, data: str) -> None:
        if not self.noise[self.open[-1]]:
            self.text.append((self.open[-1], self.block, data))
            if not data.isspace():
                self.breaks = 0

    def _last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, tags: set[str], within: set[str]) -> None:
        k = self._last(tags)
        if k > 0 and k >= self._last(within):
            if any(self.tag[i] in BLOCK for i in self.open[k:]):
                self.block += 1
            self._cut(k)

    def _is_noise(self, tag: str, attrs: dict) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        if tag == "header" or "header" in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():  # an article may have one of its own
            return not any(self.places.get(t) for t in ("article", "main"))
        return (
            tag in NOISE or "hidden" in attrs or attrs.get("aria-hidden") == "true"
            or (attrs.get("role") or "").lower() in NOISE_ROLES or bool(HIDDEN_STYLE.search(attrs.get("style") or ""))
        )

    def _kind(self, tag: str, attrs: dict) -> str:
        """How far the names of a node speak against it: strong, weak or not at all."""
        if tag in HEADINGS or tag in ("html", "body", "article", "main"):
            return ""
        names = MODIFIERS.sub(" ", f"{attrs.get('class') or ''} {attrs.get('id') or ''}")
        return "strong" if STRONG_NAMES.search(names) else "weak" if WEAK_NAMES.search(names) else ""

    def rule_out(self) -> None:
        """Make noise of nodes that their names speak against, as long as they do not hold what the page is about."""
        n = len(self.tag)
        size, holds = [0] * n, [t in ("main", "h1") for t in self.tag]
        for node, _, data in self.text:
            size[node] += len("".join(data.split()))
        for i in range(n - 1, 0, -1):
            if not self.noise[i]:
                size[self.parent[i]] += size[i]
                holds[self.parent[i]] |= holds[i]
        for i in range(1, n):
            share = size[i] / max(size[0], 1)
            strong = self.kind[i] == "strong" and not holds[i] and share < NEARLY_ALL
            weak = self.kind[i] == "weak" and share < MOST
            self.noise[i] = self.noise[i] or self.noise[self.parent[i]] or strong or weak
        self.text = [t for t in self.text if not self.noise[t[0]]]


def density(c: float, t: float, lc: float, lt: float, page_c: float, page_lc: float) -> float:
    """Composite text density of one node."""
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + page_lc / max(page_c, 1) * c + math.e)
    ratio = (c / max(lc, 1)) * (max(t, 1) / max(lt, 1))
    return c / max(t, 1) * math.log(max(ratio, math.e)) / max(math.log(base), LEAST_LOG)


def main_text(html: str | None) -> str:
    """The main text, its blocks in page order with an empty line between; empty if there is none."""
    page = Page()
    page.feed(html or "")
    page.close()
    page.rule_out()
    n = len(page.tag)
    c, t, lc, lt = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, data in page.text:
        c[node] += len("".join(data.split()))
    for i in range(n - 1, 0, -1):  # children come after their parents
        link = page.tag[i] == "a"
        lc[i] = c[i] if link else lc[i]
        if page.noise[i]:
            continue
        up = page.parent[i]
        c[up] += c[i]
        lc[up] += lc[i]
        t[up] += t[i] + 1
        lt[up] += lt[i] + link
    own = [density(c[i], t[i], lc[i], lt[i], c[0], lc[0]) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        if not page.noise[i]:
            sums[page.parent[i]] += own[i]
    best = list(range(n))  # the node with the greatest sum in each subtree, the outermost of equals
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if not page.noise[i] and sums[best[i]] > sums[best[up]]:
            best[up] = best[i]
    threshold, at = own[best[0]], best[0]
    while at > 0 and page.tag[at] not in ("body", "html"):
        threshold, at = min(threshold, own[at]), page.parent[at]
    threshold = min(threshold, own[at])
    chosen = [False] * n
    inside = [False] * n
    for i in range(n):
        up = page.parent[i]
        inside[i] = i > 0 and (inside[up] or chosen[up])
        if not inside[i] and not page.noise[i] and own[i] >= threshold and own[i] > 0:
            chosen[best[i]] = True
        inside[i] = inside[i] or chosen[i]
    _widen(page, chosen, inside, c, lc)
    leads = [False] * n  # has content below it, so that a heading beside that content belongs to it
    for i in range(n - 1, 0, -1):
        leads[page.parent[i]] = leads[page.parent[i]] or leads[i] or chosen[i]
    for i in range(1, n):
        up = page.parent[i]
        heading = page.tag[i] in HEADINGS and up > 0 and leads[up]
        inside[i] = not page.noise[i] and (inside[i] or inside[up] or heading)
    blocks: dict[int, list[str]] = {}
    for node, block, data in page.text:
        if inside[node]:
            blocks.setdefault(block, []).append(data)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(line for line in lines if line)


def _widen(page: Page, chosen: list[bool], inside: list[bool], c: list[int], lc: list[int]) -> None:
    """Content takes the article or main element that it lies in with it, and elements beside it of its tag and class."""
    n = len(page.tag)
    for i in range(n):
        up = i
        while chosen[i] and up > 0:
            up = page.parent[up]
            if up > 0 and page.tag[up] in ("article", "main"):
                chosen[up] = True
                break
    like = {(page.parent[i], page.named[i]) for i in range(1, n) if chosen[i] and page.tag[i] in ("article", "section", "div")}
    for i in range(1, n):
        same = (page.parent[i], page.named[i]) in like and 2 * lc[i] < c[i]
        chosen[i] = not page.noise[i] and (chosen[i] or same)
        inside[i] = not page.noise[i] and (inside[i] or chosen[i] or inside[page.parent[i]])


def extracted(pages: DataFrame, out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` as ``out``; a null html has an empty text.

    Only html is read. A column named ``out`` is replaced; repeated rows get
    equal texts. A page is one row and is parsed in memory.
    """
    pages = pages.drop(out)
    (name,) = fresh(pages, "_main")

    @F.pandas_udf("string")
    def main(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    keep = [F.col(f"`{c}`") for c in pages.columns]
    return pages.select(*keep, main(F.coalesce("html", F.lit(""))).alias(name)).select(*keep, F.col(name).alias(out))
