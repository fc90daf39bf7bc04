"""Main text of web pages.

The standard library's parser streams events; block tags cut them into lines. Each line has a text-to-tag ratio; the
ratios are smoothed with a Gaussian along the page, and a threshold between the two clusters of smoothed ratios marks the
content lines. They select the region that is returned: from the page inwards, an article or main element that holds at
least `ARTICLE_SHARE` of the content text, or any other element that holds nearly all of it (`REGION_SHARE`), becomes the
region. Of an article all lines are returned; of any other region the content lines and, beside them, lines that are
not mostly links, with the headings right before them.

Elements only take out what is certainly no content: menus, headers and footers of the page, sidebars, form controls,
scripts, styles. Class names and ids (whole names such as `cookie-notice`, never parts of other names) and forms are
suspects; a suspect that holds most of the page and is not mostly links is content after all.

Rows: null and empty pages, and pages without content, have empty text; broken markup is read as far as the parser
understands it, at any depth; page ids, ties and repeated rows pass through one by one; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textlode.llm.batches import arrow_map

SIGMA, RADIUS = 1.0, 2
#: Shares of the content text that make an article, or any other element, the region; and of the page's text that excuse a suspect.
ARTICLE_SHARE, REGION_SHARE, EXCUSED_SHARE = 0.5, 0.9, 0.8
#: The least share of the content text with which a page's only article is its region.
ONLY_ARTICLE_SHARE = 0.2
#: Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul title head option".split())
SKIPPED = frozenset("nav aside footer script style noscript template svg math iframe object canvas audio video select button textarea dialog menu head title search label input datalist".split())
IN_HEAD = frozenset("title meta link script style base noscript template html head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("option title head body html".split())
P_SCOPE = ("article", "aside", "blockquote", "body", "div", "main", "section", "table", "td", "li", "form", "header", "footer", "nav")
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words that name what is not content, and words that stand beside them in a name.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification alert pagination pager popup promo promoted recommend recommended related respond reply replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
FILLERS = frozenset("a and area articles bar block bottom box by button buttons cards center column content container feed form global group header icons inner item items left link links list main media panel page policy popular post posts primary right row secondary section site stories story sub thread to top unit us wrap wrapper".split())
WHOLE_NAMES = frozenset("site-header page-header search search-form searchform".split())
NAME_PARTS = re.compile(r"[-_]+")
SPACES = re.compile(r"\s+")


def suspicious(names: str) -> bool:
    """Whether a class or id names what is not content: all parts of it do so or are fillers, and one at least does."""
    for name in names.lower().split():
        parts = NAME_PARTS.split(name.strip("-_"))
        if name in WHOLE_NAMES or (any(p in NAMES for p in parts) and all(p in NAMES or p in FILLERS or p.isdigit() for p in parts)):
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page (text, tags, characters in links, region, certainly no content, heading) and its regions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # element, skipped from here on (as lines of their own: 1, silently: 2), region
        self.open: Counter[str] = Counter()
        self.parent, self.kind, self.suspect = [-1], [""], [False]  # of regions; 0 is the page
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[str, int, int, int, bool, bool]] = []

    def flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.text)).strip()
        if text:
            _, skipped, region = self.stack[-1] if self.stack else ("", 0, 0)
            self.lines.append((text, self.tags, self.linked, region, skipped > 0, any(self.open[h] for h in HEADINGS)))
            self.tags = self.linked = 0
        self.text.clear()

    def cut_to(self, depth: int) -> None:
        """Close all elements from `depth` on."""
        for name, _, _ in self.stack[depth:]:
            self.open[name] -= 1
        del self.stack[depth:]

    def close_to(self, names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        if any(self.open[n] for n in names):
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name in names:
                    self.flush()
                    self.cut_to(k)
                    return
                if name in scope:
                    return

    def leave_head(self) -> None:
        if self.open["head"]:
            self.flush()
            self.cut_to(next(k for k, (name, _, _) in enumerate(self.stack) if name == "head"))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self.leave_head()
        if tag in CLOSES_P:
            self.close_to(("p",), P_SCOPE)
        if tag in SAME:
            self.close_to(SAME[tag], SCOPE[tag])
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in ("br", "td", "th"):
            self.text.append(" ")
        if tag in VOID:
            return
        values = {k: v or "" for k, v in attrs}
        _, above, region = self.stack[-1] if self.stack else ("", 0, 0)
        role = values.get("role", "").lower()
        hidden = (
            tag in SKIPPED
            or (tag == "header" and not (self.open["article"] or self.open["main"]))
            or (role in ROLES and role != "form")
            or "hidden" in values
            or values.get("aria-hidden", "").lower() == "true"
            or "display:none" in values.get("style", "").replace(" ", "").lower()
        )
        skip = max(above, 0 if not hidden else 1 if tag in BLOCK else 2)
        if not skip and tag in BLOCK | {"td", "th", "span"}:
            named = tag not in ("html", "body", "main") and suspicious(f"{values.get('class', '')} {values.get('id', '')}")
            if tag != "span" or named:
                self.parent.append(region)
                self.kind.append("article" if "article" in (tag, role) else "main" if "main" in (tag, role) else tag)
                self.suspect.append(named or tag == "form" or role == "form")
                region = len(self.parent) - 1
        self.stack.append((tag, skip, region))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        foreign = self.open["svg"] or self.open["math"] or tag in ("svg", "math")
        self.handle_starttag(tag, attrs)  # outside of foreign elements a slash closes nothing
        if tag in ("script", "style") and not foreign:
            self.set_cdata_mode(tag)
        elif foreign:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                self.cut_to(k)
                return
            if name in ("article", "main", "body", "table") and tag not in ("article", "main", "body", "html", "table"):
                return

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in ("head", "html") and self.open["head"] and data.strip():
            self.leave_head()
        if self.stack and self.stack[-1][1] == 2:
            return
        self.text.append(data)
        if self.open["a"]:
            self.linked += len(data.strip())

    def done(self) -> None:
        self.close()
        self.flush()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing along the page, with weights that sum to one at its ends too."""
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    full = lambda x: np.convolve(x, kernel)[RADIUS : RADIUS + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def threshold(values: np.ndarray) -> float:
    """Halfway between the centres of the two clusters of `values`."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        cut = (low + high) / 2
        above = values > cut
        if above.all() or not above.any():
            return cut
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _subtotals(values: np.ndarray, region: np.ndarray, parent: list[int]) -> list[float]:
    """The sum of the lines' values in each region with all that is in it; a region comes after its parent."""
    out = np.bincount(region, values, len(parent)).tolist()
    for r in range(len(parent) - 1, 0, -1):
        out[parent[r]] += out[r]
    return out


def _region(page: Lines, votes: list[float], dropped: list[bool], usable_in: list[float]) -> int:
    """From the page inwards, the region that holds the content."""
    inner: dict[int, list[int]] = {}
    for r in range(1, len(votes)):
        if votes[r] > 0 and not dropped[r]:
            inner.setdefault(page.parent[r], []).append(r)
    best = 0
    while page.kind[best] != "article":
        share = lambda r: ARTICLE_SHARE if page.kind[r] in ("article", "main") else REGION_SHARE
        heavy = [r for r in inner.get(best, []) if votes[r] >= share(r) * votes[best] and (page.kind[best] != "main" or page.kind[r] != "p") and page.kind[r] not in ("p", "ul", "ol", "pre", "blockquote", "table")]
        if not heavy:
            break
        best = max(heavy, key=lambda r: (votes[r], -r))
    path, r = [], best
    while r > 0:
        path.append(page.kind[r])
        r = page.parent[r]
    if "article" in path or "main" in path:
        while best > 0 and page.kind[best] not in ("article", "main"):  # a part of an article isn't all of it
            best = page.parent[best]
        return best
    outer = [False] * len(votes)
    articles = []
    for r in range(1, len(votes)):
        outer[r] = outer[page.parent[r]] or page.kind[r] == "article"
        if page.kind[r] == "article" and not outer[page.parent[r]] and not dropped[r] and usable_in[r] > 0:
            articles.append(r)
    return articles[0] if len(articles) == 1 and votes[articles[0]] >= ONLY_ARTICLE_SHARE * votes[0] else best


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.done()
    lines, parent = page.lines, page.parent
    if not lines:
        return ""
    size, tags, linked = (np.array(c, float) for c in ([len(line[0]) for line in lines], [line[1] for line in lines], [line[2] for line in lines]))
    region = np.array([line[3] for line in lines])
    kept = np.array([not line[4] for line in lines])
    text_in, links_in = _subtotals(size * kept, region, parent), _subtotals(linked * kept, region, parent)
    dropped = [False] * len(parent)
    for r in range(1, len(parent)):
        excused = text_in[r] >= EXCUSED_SHARE * text_in[0] and 2 * links_in[r] < text_in[r]
        dropped[r] = dropped[parent[r]] or (page.suspect[r] and not excused)
    usable = kept & ~np.array(dropped)[region]
    if not usable.any():
        return ""
    ratios = np.where(usable, np.maximum(size - linked, 0) / np.maximum(1, tags), 0.0)
    smooth = smoothed(ratios)
    cut = min(threshold(smooth), smooth[usable].max())
    content = usable & ((smooth >= cut) | (ratios >= cut))
    usable_in = _subtotals(size * usable, region, parent)
    best = _region(page, _subtotals(size * content, region, parent), dropped, usable_in)
    inside = [False] * len(parent)
    inside[best] = True
    for r in range(best + 1, len(parent)):
        inside[r] = inside[parent[r]]
    within = usable & np.array(inside)[region]
    if page.kind[best] in ("article", "main"):
        return "\n\n".join(lines[k][0] for k in np.flatnonzero(within))
    mine = np.flatnonzero(within & content & (2 * ratios >= cut))  # smoothing alone makes no end of the text
    chosen = within & (content | (2 * linked <= size))
    if usable_in[best] == usable_in[0] and len(mine):  # a region that is the whole page says nothing about its ends
        chosen[: mine[0]] = False
        chosen[mine[-1] + 1 :] = False
    at = np.flatnonzero(chosen)
    k = int(at[0]) - 1 if len(at) else -1
    while k >= 0 and usable[k] and lines[k][5] and 2 * linked[k] <= size[k]:
        chosen[k] = True
        k -= 1
    return "\n\n".join(lines[k][0] for k in np.flatnonzero(chosen))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def make():
        def run(batch: pa.RecordBatch) -> list:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            return [batch.column(0), batch.column(1), pa.array(texts, pa.string()), [len(t) for t in texts]]

        return run

    return arrow_map(df.select(id_col, url_col, html_col), make, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
