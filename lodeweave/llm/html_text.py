"""Main text of web pages by two passes of block rules.

A scan cuts a page into blocks at block-level tags and notes each block's
length, stop-word density and link density, whether it is a heading, and whether
it stands in the page's article or in a part that is never article (menus, forms,
adverts, comments, hidden parts, ...). Words in classes and ids are hints only: a
part that holds the page's article or nearly all of its dense text is no menu,
whatever its class says. Pass one decides what these tell by
themselves; short or middling blocks stay open. Pass two gives every open block
the label of its nearest decided neighbours. Text outside the article is dropped
where the article outweighs it.

Where a page has next to none of the listed stop words (other languages, other
scripts), sentence marks stand in for them.

A null page is empty and gives an empty text. Pages are handled one by one, so
repeated rows and ids need nothing special; other columns pass through, but those
called text and n_chars. Time grows in proportion to the page, whatever its tags. An
empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.quality_model import STOP_WORDS
from lodeweave.llm.storage import ref

#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; none of it is text of the page.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
#: Elements whose content is skipped where they are closed before the next of their kind begins; else the tag alone is.
EMBEDDED = frozenset("svg math object canvas audio video".split())
#: Elements that are never article text.
NEVER = frozenset("nav footer aside form button select option menu dialog fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: Words in a class or id that mark a part as something else than article.
HINTS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe subscription paywall share sharing social sidebar widget related recommended recommendations breadcrumb breadcrumbs "
    "pagination pager menu nav navbar navigation footer masthead topbar toolbar comment comments disqus reply replies respond login signup search tags".split()
)
WEAK_HINTS = frozenset({"header"})  # a header inside the article is its own
#: A class that begins with one of these says what a part has or is about (has-sidebar, tag-search), not what it is.
MODIFIERS = frozenset("has no with without is tag category cat".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"[.,;:!?…。、，！？．；،؟۔।]")
_IDEOGRAPH = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]")


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    article: bool
    never: bool
    part: int = 0
    dense: float = 0.0


@dataclass
class Part:
    """A part whose class or id holds a hint; the first of a page is the page itself."""

    parent: int = 0
    firm: bool = True
    in_article: bool = False
    own: int = 0  # characters of dense text, outside parts within
    inside: int = 0  # and in all
    articles: int = 0  # and in articles that begin in the part


class _Tags:
    """Places of one element's tags in a page; each is searched for once, from left to right."""

    def __init__(self, page: str, name: str):
        self.page, self.at = page, {}
        self.tags = {closing: re.compile(f"<{'/' if closing else ''}{name}(?=[\\s/>])", re.I) for closing in (False, True)}

    def _next(self, closing: bool, at: int) -> int:
        if self.at.get(closing, -1) < at:
            found = self.tags[closing].search(self.page, at)
            self.at[closing] = found.start() if found else len(self.page)
        return self.at[closing]

    def shut(self, at: int) -> int:
        """Where the element that begins before ``at`` is closed; -1 if another begins first, or it never is."""
        end = self._next(True, at)
        return end if end < min(self._next(False, at), len(self.page)) else -1


def _hinted(attributes: str, in_article: bool) -> bool | None:
    """Whether a hint in a class or id is more than a modifier; None without hints."""
    firm = None
    for found in _ATTR.finditer(attributes):
        if found[1].lower() in ("class", "id"):
            for token in (found[2] or found[3] or found[4] or "").split():
                parts = [p.lower() for p in _PART.findall(token)]
                if any(p in HINTS or (not in_article and p in WEAK_HINTS) for p in parts):
                    firm = bool(firm) or parts[0] not in MODIFIERS
    return firm


def _never(name: str, attributes: str, in_article: bool) -> bool:
    if name in NEVER or (name == "header" and not in_article):
        return True
    if not attributes or attributes.isspace():
        return False
    for found in _ATTR.finditer(attributes):
        key, value = found[1].lower(), (found[2] or found[3] or found[4] or "")
        if key == "role" and value.lower() in ROLES:
            return True
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's blocks that hold text, in order."""
    out: list[Block] = []
    texts: list[str] = []
    # open elements: name, whether it starts a part that is never article, whether it is an article, the hinted part around it
    stack: list[tuple[str, bool, bool, int]] = []
    parts, part = [Part()], 0
    never = article = links = link_chars = 0
    heading = ""
    at, end = 0, len(page)
    opened: Counter = Counter()  # how often each name stands in the stack
    embedded = {name: _Tags(page, name) for name in EMBEDDED}

    def close() -> None:
        nonlocal link_chars
        text = " ".join("".join(texts).split())
        if text:
            out.append(Block(text, min(link_chars, len(text)), bool(heading), article > 0, never > 0, part))
        texts.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        text = html.unescape(raw) if "&" in raw else raw
        texts.append(text)
        if links:
            link_chars += len(" ".join(text.split()))

    while at < end:
        open_ = page.find("<", at)
        if open_ < 0:
            add(page[at:])
            break
        if open_ > at:
            add(page[at:open_])
        if page.startswith("<!--", open_):
            stop = page.find("-->", open_ + 4)
            at = end if stop < 0 else stop + 3
            continue
        closing = page.startswith("</", open_)
        found = _NAME.match(page, open_ + 1 + closing)
        if not found:
            if page[open_ + 1 : open_ + 2] in ("!", "?", "/"):
                stop = page.find(">", open_)
                at = end if stop < 0 else stop + 1
            else:
                add("<")
                at = open_ + 1
            continue
        name = found[0].lower()
        rest = _REST.match(page, found.end())
        stop = rest.end() if rest else page.find(">", found.end()) + 1 or end
        attributes = page[found.end() : stop - 1]
        at = stop
        if name in BLOCK:
            close()
        elif name == "br":
            texts.append(" ")
        if closing:
            if name in HEADINGS:
                heading = ""
            if name == "a":
                links = max(0, links - 1)
            while opened[name]:  # what is closed with it is gone for good, so each element is met once
                last, bad, good, part = stack.pop()
                opened[last] -= 1
                never -= bad
                article -= good
                if last == name:
                    break
            continue
        if name in EMBEDDED:
            shut = -1 if attributes.endswith("/") else embedded[name].shut(at)
            at = at if shut < 0 else shut
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                shut = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
                at = shut.start() if shut else end
            continue
        if name in VOID:
            continue
        if name == "a":
            links += 1
        elif name in HEADINGS:
            heading = name
        if name in BLOCK or name == "span":
            if name == "body":
                continue
            bad = _never(name, attributes, article > 0)
            good = name in ("article", "main")
            # an article's own class tells its topics; one within an article may be a comment
            firm = None if name in ("html", "main") or (good and not article) else _hinted(attributes, article > 0)
            if name not in ("p", "li", "dd", "dt", "option", "tr", "td", "th") or bad or firm is not None:  # these may go unclosed
                stack.append((name, bad, good, part))
                opened[name] += 1
                if firm is not None:
                    parts.append(Part(part, firm, article > 0))
                    part = len(parts) - 1
                never += bad
                article += good
    close()
    _measure(out)
    if len(parts) > 1:
        stands = _standing(out, parts)
        for b in out:
            b.never = b.never or stands[b.part]
    return out


def _standing(found: list[Block], parts: list[Part], least: int = 500, times: int = 10) -> list[bool]:
    """Whether each part's hints hold: not where the dense text is in the part rather than beside it.

    Beside it is what stands in no other hinted part, or in one whose hints do not hold. Articles in the part count as they
    are; other text must outweigh what is beside it, by far if the hint is firm, as comments may be longer than the article.
    """
    for b in found:
        if first_pass(b) in ("good", "near"):
            parts[b.part].own += len(b.text)
            parts[b.part].inside += len(b.text)
            if b.article and not parts[b.part].in_article:
                parts[b.part].articles += len(b.text)
    within: list[list[int]] = [[] for _ in parts]
    for i in range(len(parts) - 1, 0, -1):  # parts within come after
        p = parts[i]
        around = parts[p.parent]
        around.inside += p.inside
        if not around.in_article:
            around.articles += p.inside if p.in_article else p.articles
        within[p.parent].append(i)
    stands = [True] * len(parts)
    stands[0] = False
    todo = [(0, 0)]
    while todo:
        at, outside = todo.pop()
        beside, freed = outside + parts[at].own, []
        for i in sorted(within[at], key=lambda k: (parts[k].firm, k)):
            p = parts[i]
            outweighs = p.inside > times * beside and p.inside >= least if p.firm else p.inside > beside
            if p.articles > beside or outweighs:
                stands[i] = False
                beside += p.inside
                freed.append(i)
        todo += [(i, beside - parts[i].inside) for i in freed]
    return stands


def _size(text: str) -> int:
    """Characters, an ideograph or syllable sign as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_IDEOGRAPH.findall(text))


def _measure(found: list[Block], short: int = 70, least: float = 0.03, marks: float = 1 / 60) -> None:
    """Each block's stop-word density; on a page that has next to none of the words listed, by its sentence marks."""
    total = hits = 0
    open_ = [b for b in found if not b.never and _size(b.text) >= short and b.link_chars <= 0.5 * len(b.text)]
    for b in open_:
        words = _WORD.findall(b.text.lower())
        n = sum(w in STOP_WORDS for w in words)
        total, hits = total + len(words), hits + n
        b.dense = n / len(words) if words else 0.0
    if hits < least * total:
        for b in open_:
            b.dense = 0.12 * len(_MARK.findall(b.text)) / (marks * _size(b.text))


def first_pass(block: Block, short: int = 70, long: int = 200) -> str:
    """good, bad, near (open, likely good) or short (open)."""
    if block.never:
        return "bad"
    size = _size(block.text)
    linked = block.link_chars / len(block.text)
    if linked > 0.5:
        return "bad"
    if size < short:
        return "bad" if linked > 0.25 else "short"
    dense = block.dense
    if dense >= 0.12:
        return "good" if size >= long or block.article else "near"
    if dense >= 0.05 or block.article:
        return "good" if block.article else "near"
    return "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is kept: open ones follow the nearest decided neighbours.

    Parts that are never article are decided by their markup; they say nothing of what stands beside them.
    """
    n, far = len(labels), len(labels) + 1
    left: list[tuple[int, bool | None]] = []
    last: tuple[int, bool | None] = (-far, None)
    for i, label in enumerate(labels):
        left.append(last)
        if label in ("good", "bad") and not found[i].never:
            last = (i, label == "good")
    out = [False] * n
    last = (n + far, None)
    for i in range(n - 1, -1, -1):
        label, block = labels[i], found[i]
        if label in ("good", "bad"):
            out[i] = label == "good"
            if not block.never:
                last = (i, out[i])
            continue
        lean = block.article or label == "near"
        (a, before), (b, after) = left[i], last
        if block.heading and block.article:
            out[i] = lean if after is None else after or bool(before)
        elif before is None and after is None:
            out[i] = lean
        elif before is None or after is None or before == after:
            out[i] = bool(after if before is None else before)
        elif i - a != b - i:
            out[i] = bool(before if i - a < b - i else after)
        else:
            out[i] = lean
        if block.article and before is not True and after is not True:
            out[i] = True  # nothing decided on either side speaks for the article but its own markup
    return out


def main_text(page: str | None) -> str:
    """The kept blocks, in page order, joined by line feeds."""
    found = blocks(page or "")
    kept = second_pass(found, [first_pass(b) for b in found])
    inside, outside = (sum(len(b.text) for k, b in zip(kept, found) if k and b.article == a) for a in (True, False))
    if inside > outside:
        kept = [k and b.article for k, b in zip(kept, found)]
    return "\n".join(b.text for k, b in zip(kept, found) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``html`` replaced by ``text`` and ``n_chars``."""
    keys = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]
    names = [f.name for f in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            columns = [*(batch.column(p) for p in plain), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.record_batch(columns, [*plain, "text", "n_chars"])

    plain = [f"key{i}" for i in range(len(names))]  # Arrow functions do not take names with dots
    schema = ", ".join([*(f"{p} {f.dataType.simpleString()}" for p, f in zip(plain, keys)), "text string, n_chars long"])
    rows = pages.select(*[F.col(ref(n)).alias(p) for n, p in zip(names, plain)], F.col("html"))
    return rows.mapInArrow(run, schema).toDF(*names, "text", "n_chars")
