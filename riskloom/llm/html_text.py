"""Main text of web pages by two-pass block rules.

First pass: the page is cut into blocks; each is judged by itself from stop-word density, length and link density, and from where
it stands (inside an article or main element, or inside menus, headers, footers, sidebars, notices, adverts, forms, comments).
Second pass: ambiguous short blocks take the label of the nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common function words of five languages.
STOP_WORDS = frozenset("""
a about after all also an and are as at be because been but by can for from had has have he her his if in into is it its more no not
of on one or other our out she so than that the their there they this to up was we were what when which who will with would you
au aux avec ce ces dans de des du elle en est et être il ils je la le les leur mais même ne nous on ou par pas pour que qui sa se ses
son sont sur un une vous
aber als am an auch auf aus bei das dass dem den der des die ein eine einen einer für hat ich im in ist mit nach nicht noch nur oder
sich sie sind so und uns von vor war wenn wie wir zu zum zur über
al con como del el ella en era es esta este ha las lo los más me muy no nos o para pero por que se si sin sobre su sus también un una y ya
da di che il non per una sono come
""".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("""script style noscript template svg math head title textarea select option button iframe object canvas audio video
map datalist nav footer aside form menu dialog""".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NOISE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie
cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social sidebar widget
widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager related recommended recommendations comment comments commentlist
disqus respond reply replies footer masthead copyright login search toolbar skip teaser outbrain taboola""".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
MAIN_NAMES = frozenset("article-body articlebody article-content article-text entry-content post-content post-body story-body main-content page-content".split())

#: A name with one of these tells about the page or a wrapper: no-sidebar, content-sidebar-wrap, cookie-banner-shown.
ABOUT = frozenset("no not has have with without is wrap wrapper layout container page shown hidden open closed enabled disabled fixed".split())
HARD, FIRM, SOFT = 1, 2, 3  # noise for sure; by its name; by a name that only tells about a wrapper, or a form

TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
WORD = re.compile(r"[^\W\d_]+")

LINK_DENSE, SHORT, LONG, STOPS_LOW, STOPS_HIGH = 0.34, 70, 200, 0.10, 0.18


def _kind(tag: str, attributes: str, in_main: bool) -> tuple[int, bool]:
    """(0 or the kind of noise, is the main container) of an opening tag."""
    found = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    role = found.get("role", "").lower()
    noise = (tag in DROPPED and tag != "form") or role in NOISE_ROLES or (tag == "header" and not in_main)
    named = SOFT if tag == "form" else 4
    names = (found.get("class", "") + " " + found.get("id", "")).lower().split()
    if tag not in ("html", "body", "article", "main"):
        for n in names:
            words = [w for w in re.split(r"[-_]+", n) if w]
            if any(w in NOISE_WORDS for w in words) or ("header" in words and not in_main):
                named = min(named, SOFT if len(words) > 1 and not ABOUT.isdisjoint(words) else FIRM)
    noise = noise or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    main = tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" or any(n in MAIN_NAMES for n in names)
    if noise or (named == FIRM and tag not in BLOCK):
        return HARD, main
    return (named if named < 4 and tag in BLOCK and not (main and named == SOFT) else 0), main


class Block:
    __slots__ = ("text", "linked", "heading", "main", "label", "under")

    def __init__(self, text: str, linked: int, heading: bool, main: bool, under: tuple):
        self.text, self.linked, self.heading, self.main, self.label, self.under = text, linked, heading, main, "", under


class Named:
    """An element that is noise by its name, unless it holds the page's own text."""

    __slots__ = ("kind", "depth", "text")

    def __init__(self, kind: int, depth: int):
        self.kind, self.depth, self.text = kind, depth, 0


def _stops(text: str) -> float:
    words = [w.lower() for w in WORD.findall(text)]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _listed(found: list[Block]) -> bool:
    """Whether one of the listed languages fits the page's longer blocks; without any, it counts as fitting."""
    long = " ".join(b.text for b in found if len(b.text) >= SHORT and b.linked <= LINK_DENSE * len(b.text))
    return not long or _stops(long) >= STOPS_LOW


def _spare(found: list[Block], mains: list[tuple], elements: list[Named]) -> list[Block]:
    """The blocks outside noise. A named element is spared if it holds the only article or main elements and half
    of the page's dense text, or most of the page's dense text."""
    listed, total, left = _listed(found), 0, set(elements)
    for b in found:
        if len(b.text) >= SHORT and b.linked <= LINK_DENSE * len(b.text) and (not listed or _stops(b.text) >= STOPS_LOW):
            total += len(b.text)
            for e in b.under:
                e.text += len(b.text)
    for e in sorted(elements, key=lambda e: (e.depth, -e.text)):  # outermost first
        alone = 2 * e.text >= total and any(e in m for m in mains) and not any(left.isdisjoint(m) for m in mains)
        if alone or (e.text > 0.5 * total if e.kind == SOFT else e.text > 0.9 * total and e.text >= 1_000):
            left.discard(e)
    return [b for b in found if left.isdisjoint(b.under)]


def blocks(html: str) -> list[Block]:
    """Blocks of the page in order, without those inside noise. White space is one space, references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, noise for sure, main container
    under: list[tuple[int, Named]] = []  # open named elements and their place on the stack
    elements: list[Named] = []
    mains: list[tuple] = []  # the named elements around each main container
    parts: list[str] = []
    linked, breaks, noise, main, links = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal parts, linked, breaks
        text = " ".join("".join(parts).split())
        if text:
            heading = any(len(t) == 2 and t[0] == "h" and t[1] in "123456" for t, _, _ in stack)
            out.append(Block(text, min(linked, len(text)), heading, main > 0, tuple(e for _, e in under)))
        parts, linked, breaks = [], 0, 0

    def pop(depth: int) -> None:
        nonlocal noise, main, links
        while len(stack) > depth:
            t, n, m = stack.pop()
            noise, main, links = noise - n, main - m, links - (t == "a")
        while under and under[-1][0] >= depth:
            under.pop()

    def close(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for d in range(len(stack) - 1, -1, -1):
            if stack[d][0] in names:
                pop(d)
                return
            if stack[d][0] in stop:
                return

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        piece = html[at:m.start() if m else end]
        if piece and not noise:
            text = unescape(piece)
            parts.append(text)
            if links:
                linked += len(text.strip())
            if text.strip():
                breaks = 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                flush()
            if any(t == tag for t, _, _ in stack):
                depth = max(i for i, s in enumerate(stack) if s[0] == tag)
                if tag in BLOCK or tag in DROPPED or not any(s[0] in BLOCK for s in stack[depth:]):
                    pop(depth)  # an inline end tag does not close blocks
            continue
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES:
                close(CLOSES[tag], ("ul", "ol", "dl", "table", "select"))
            elif tag not in ("option",):
                close(("p",), ("div", "section", "article", "td", "th", "li", "blockquote", "body"))
        if tag in VOID:
            continue
        bad, container = _kind(tag, m[3] or "", main > 0)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = stop.start() if stop else end
        elif (m[3] or "").rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag == "a":
            close(("a",), tuple(BLOCK))
        hard = bad == HARD
        if bad and not hard and not noise:
            elements.append(Named(bad, len(stack)))
            under.append((len(stack), elements[-1]))
        stack.append((tag, hard, container and not noise and not bad))
        if stack[-1][2]:
            mains.append(tuple(e for _, e in under))
        noise, main, links = noise + hard, main + stack[-1][2], links + (tag == "a")
    flush()
    return _spare(out, mains, elements) if elements else out


def judge(found: list[Block]) -> None:
    """First pass labels good, bad, near or short; the second pass leaves good and bad only. Where the page has an article or main
    element, standing in it is one more feature: it helps a block that is not decided, and only blocks outside it speak for those outside."""
    contained, listed = any(b.main for b in found), _listed(found)
    for b in found:
        n, density = len(b.text), b.linked / len(b.text)
        stops = _stops(b.text) if listed else STOPS_HIGH  # no listed language fits: length and links decide
        if density > LINK_DENSE and not (b.main and (density <= 0.8 or n >= LONG)) or "©" in b.text[:40]:
            b.label = "bad"
        elif n < SHORT:
            b.label = "bad" if b.linked and not b.main else "short"
        elif stops >= STOPS_HIGH:
            b.label = "good" if n >= LONG or b.main else "near"
        else:
            b.label = "near" if stops >= STOPS_LOW or b.main else "bad"
    if not any(b.label in ("good", "bad") for b in found):
        for b in found:
            b.label = "good" if b.label == "near" else b.label
    if contained:
        _neighbours([b for b in found if b.main], "good", False)
        _neighbours([b for b in found if not b.main], "bad", True)
    else:
        _neighbours(found, "bad", False)


def _neighbours(found: list[Block], edge: str, outside: bool) -> None:
    """Second pass over blocks on one side of the container; `edge` is what stands before the first and after the last.
    `outside` a container a short block needs good text on both sides, or after a heading."""
    decided, k = [i for i, b in enumerate(found) if b.label in ("good", "bad")], 0
    labels = [b.label for b in found]
    for i, b in enumerate(found):
        while k < len(decided) and decided[k] < i:
            k += 1
        if labels[i] not in ("near", "short"):
            continue
        before = labels[decided[k - 1]] if k else edge
        after = labels[decided[k]] if k < len(decided) else edge
        if labels[i] == "near":
            b.label = "good" if "good" in (before, after) else "bad"
        elif before == after:
            b.label = before
        elif b.heading:
            b.label = after
        elif outside:
            b.label = "bad"
        else:  # the nearer of the two decides
            left = i - decided[k - 1] if k else len(found)
            right = decided[k] - i if k < len(decided) else len(found)
            b.label = before if left <= right else after


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    judge(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """`pages` without the html, with `out` (main text, empty if there is none) and `n_chars` (its code points).

    Null and empty pages give an empty text; repeated rows stay; an empty table gives no rows; other columns pass, but columns
    named like the new ones are replaced.
    """
    kept = [c for c in pages.columns if c not in (html_col, out, "n_chars")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema] + [f"`{out}` string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=kept + [out, "n_chars"])

    return pages.select(*kept, F.col(html_col).alias("__html")).mapInArrow(run, schema)
