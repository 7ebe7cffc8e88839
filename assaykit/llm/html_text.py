"""Main text of web pages by line-block distribution.

A page is cut into lines at its block elements; tags with no text between make no line, however
deeply they are nested. What says itself that it is not article (menus, adverts, footers ...) leaves
lines of length zero, and lines that are nothing but links weigh nothing. Over a sliding window of
lines the weights are summed: where the sum rises over a threshold the text surges, where it falls to
zero it dives, and the lines between are kept, with the short ones that lead up to the surge.

A class or id that names boilerplate drops an element, but not one that wraps the page: not if the
name only says what the page has or lacks, nor if a heading of the page or an article lies in it. If
nothing that surges would be left of a page that has such text, elements with half of the text or more
are taken for wrappers too. Where an ``article`` or ``main`` element that is no
boilerplate itself holds the page's largest surge, all text of such elements is kept, short paragraphs
too, and nothing else is; on other pages the line blocks of the whole page decide.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import body, col

#: lines in a window, and characters with which a text surges
WINDOW = 3
SURGE = 60

# Names of HTML elements and usual words of class, id and role attributes.
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table
tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
DROPPED = frozenset("nav footer aside form head title script style noscript template iframe noframes svg math object button select textarea menu dialog".split())
DROPPED_OUTSIDE = frozenset(["header"])  # the header inside an article belongs to it
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
footer gdpr login menu modal nav navbar navigation newsletter notice notices notification paywall popup promo promotion related reply replies
share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary search""".split())
MARKS_OUTSIDE = frozenset(["header", "masthead"])
#: elements that are never the page itself
ALWAYS = DROPPED - {"form", "dialog", "menu"}
UNMARKED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset(["article", "main"])
#: an article may be of a topic or layout that MARKS names; these say that it is not the page's own text
ARTICLE_MARKS = frozenset("""ad ads adv advert adverts advertisement advertising comment comments promo promotion related reply replies
sponsor sponsored teaser teasers""".split())
ARTICLE_NOTES = frozenset("category format has is no not tag type with without".split())  # has-comments, tag-related: a property, not a kind
NOTES = frozenset("has no not with without".split())
LACKS = frozenset("free less off disabled hidden none".split())  # ad-free
#: words that go with a mark in a name without making it another thing: related-posts is boilerplate in an article, related-work is not
COMPANIONS = frozenset("""area article articles bar block blocks body box button buttons card cards col column container content count entry field form
group header heading icon icons inner input item items label left link links list main meta news note outer panel post posts primary right section
secondary site slot stories story thread title top bottom unit user wrap wrapper author""".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'=]|=\s*+"[^"]*"|=\s*+'[^']*'|[="'])*+)(?:>|\Z)""", re.S)
LABEL = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z0-9]+")
BLANK = re.compile(r"[ \t\n\x0b\x0c\r]+")
SEPARATORS = " \t\n\x0b\x0c\r|\u00b7\u2022/\u00bb\u203a>-\u2013,;:"  # what stands between the links of a menu
RIGHTS = re.compile(r"\s*(?:\u00a9|\(c\)\s|copyright\b)", re.I)


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is text, open or close; comments and declarations are left out."""
    out, at = [], 0
    while m := TAG.search(page, at):
        if m.start() > at:
            out.append(("text", page[at:m.start()], ""))
        at = m.end()
        if m[2]:
            name = m[2].lower()
            out.append(("close" if m[1] else "open", name, m[3]))
            if name in RAW and not m[1]:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                stop = end.start() if end else len(page)
                out.append(("text", page[at:stop], ""))
                at = stop
    if at < len(page):
        out.append(("text", page[at:], ""))
    return out


def partners(found: list[tuple[str, str, str]]) -> dict[int, int]:
    """Position of the closing tag of every element that has one."""
    opened: dict[str, list[int]] = {}
    match = {}
    for i, (kind, name, _) in enumerate(found):
        if kind == "open" and name not in VOID:
            opened.setdefault(name, []).append(i)
        elif kind == "close" and opened.get(name):
            match[opened[name].pop()] = i
    return match


def is_boilerplate(name: str, attributes: str, inside: bool) -> bool:
    """Whether the element says that it is no article, by its own name or by a class, id or role."""
    if name in DROPPED or name in DROPPED_OUTSIDE and not inside:
        return True
    if name in UNMARKED or name in VOID or "=" not in attributes:
        return False
    names = [n for m in LABEL.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    said = [w for n in names if (w := WORD.findall(n))]
    if name == "article":
        return any(w[0] not in ARTICLE_NOTES and not ARTICLE_MARKS.isdisjoint(w) for w in said)
    said = [w for w in said if w[0] not in NOTES and w[-1] not in LACKS]
    if inside:
        return any(not MARKS.isdisjoint(w) and all(x in MARKS or x in COMPANIONS or x.isdigit() for x in w) for w in said)
    return any(not MARKS.isdisjoint(w) or not MARKS_OUTSIDE.isdisjoint(w) for w in said)


def is_page(kind: str, name: str, attributes: str) -> bool:
    """Whether a tag opens what only the page itself has."""
    return kind == "open" and (name in ("main", "h1") or name == "article" and not is_boilerplate(name, attributes, False))


def page_lines(page: str, lenient: bool = False) -> tuple[list[str], list[int], list[int]]:
    """The page's lines in order, boilerplate as empty lines; the number of the outermost article or main each is in (0: none); their weights."""
    found = tokens(page)
    match = partners(found)
    raw = {i + 1 for i, (kind, name, _) in enumerate(found) if kind == "open" and name in RAW}
    sizes = list(accumulate((len(name.strip()) if kind == "text" and i not in raw else 0 for i, (kind, name, _) in enumerate(found)), initial=0))
    heads = list(accumulate(map(int, (is_page(*x) for x in found)), initial=0))
    lines, owners, weights, parts, inside, n_roots, until, links, i = [], [], [], [], 0, 0, [], 0, 0

    def wraps(start: int, end: int) -> bool:
        """Whether an element holds the page rather than a part beside it."""
        return heads[end] > heads[start + 1] or lenient and 2 * (sizes[end] - sizes[start]) >= sizes[-1]

    def add(line: str, weight: int) -> None:
        lines.append(line)
        owners.append(n_roots if inside else 0)
        weights.append(weight)

    def new_line() -> None:
        if line := BLANK.sub(" ", "".join(x for x, _ in parts)).strip(" "):
            plain = any(x.strip(SEPARATORS) for x, linked in parts if not linked)
            add(line, len(line) if plain and not RIGHTS.match(line) else 0)
        parts.clear()

    while i < len(found):
        kind, name, attributes = found[i]
        if kind == "text":
            parts.append((html.unescape(name), links > 0))
        else:
            if name in BLOCKS:
                new_line()
            if name == "a":
                links = links + 1 if kind == "open" and i in match else max(0, links - 1) if kind == "close" else links
            if kind == "open" and is_boilerplate(name, attributes, bool(inside)) and not (
                    name not in ALWAYS and i in match and wraps(i, match[i])):
                end = match.get(i)
                if end is None and (name in DROPPED or name in DROPPED_OUTSIDE):
                    # never closed: it ends where an article begins, or with the page
                    end = next((k - 1 for k in range(i + 1, len(found)) if found[k][0] == "open" and found[k][1] in ROOTS), len(found))
                if end is not None:
                    if name in BLOCKS:
                        for _ in range(WINDOW):
                            add("", 0)
                    i = end
            elif kind == "open" and name in ROOTS:
                n_roots += not inside
                inside += 1
                until.append(match.get(i, len(found)))
            while until and until[-1] <= i:
                if parts and inside == 1:  # closed within boilerplate
                    new_line()
                until.pop()
                inside -= 1
        i += 1
    new_line()
    return lines, owners, weights


def surging(lengths: list[int], threshold: int) -> list[tuple[int, int]]:
    """Ranges of lines from a surge (the window's sum exceeds the threshold) to the next dive (the sum is zero).

    A surge starts after the dive or the last line without weight before it: a title or a byline
    belongs to the text that it adjoins, a line of links does not. Nor do such lines at its end.
    """
    windows = [sum(lengths[i:i + WINDOW]) for i in range(len(lengths))]
    spans, start, dived = [], None, 0
    for i, total in enumerate(windows):
        if start is None and not lengths[i]:
            dived = i + 1
        elif start is None and total > threshold:
            start = dived
        elif total == 0:
            if start is not None:
                spans.append((start, i))
            start, dived = None, i + 1
    if start is not None:
        end = len(lengths)
        while not lengths[end - 1]:
            end -= 1
        spans.append((start, end))
    return spans


def in_roots(lengths: list[int], owners: list[int]) -> bool:
    """Whether the lines of article and main elements are the page's text: one of them holds the largest surge.

    A stretch is what lies between two bounds of outermost elements. The surges of one add up, so an
    advert in the middle of a text does not make it smaller than a comment. Without a surge any text
    in such an element will do.
    """
    best, rooted = 0, any(n and o for n, o in zip(lengths, owners))
    for owner, group in groupby(zip(owners, lengths), key=lambda x: x[0]):
        stretch = [n for _, n in group]
        size = sum(sum(stretch[a:b]) for a, b in surging(stretch, SURGE))
        if size > best:
            best, rooted = size, owner > 0
    return rooted


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by one space; empty if there is none."""
    if not page:
        return ""
    lines, owners, weights = page_lines(page)
    if not surging(weights, SURGE):
        again = page_lines(page, lenient=True)
        if surging(again[2], SURGE):
            lines, owners, weights = again
    if in_roots([len(x) for x in lines], owners):
        return " ".join(x for x, o in zip(lines, owners) if x and o)
    spans = surging(weights, SURGE)
    if not spans and any(weights):  # a short page without any surge: its largest run of lines
        spans = [max(surging(weights, 0), key=lambda s: sum(weights[s[0]:s[1]]))]
    return " ".join(x for a, b in spans for x in lines[a:b] if x)


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with the main text.

    A null or empty page gives an empty text, as does a page without text. Repeated pages get equal
    texts. A column called like the result is replaced; an empty table gives an empty table. Work is
    by row: nothing moves between tasks.
    """
    return pages.withColumn(out, _main_text(body(col(html))))
