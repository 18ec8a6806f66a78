"""HTML extraction by line-block distribution.

Mark-up is stripped to lines, one for each block; runs of white space in a block become one space.  Lines in menus,
headers of the page, footers, sidebars, notices, adverts, forms, comment sections and the like are noise and taken out.
Any other line weighs as many characters as it has, or nothing if it is mostly links.  The weights are summed over a
window of lines that slides over the page.  A surge is where the window sum reaches SURGE and a dive where it falls below
DIVE; the lines between a surge and its dive are the text.  So short untagged lines (navigation by words, credits,
imprints) that lie further than a window from the paragraphs fall away, and short lines among paragraphs stay.  A page whose windows never surge keeps every line that weighs.

Where the page marks its article (article or main elements), its own bounds stand for surge and dive: all lines in
them that are no noise are the text, link lists too, for a run's length cannot tell a list of sources from a menu.

Elements are noise by their tag, or by a name in class, id, role or aria-label: a name that is one of the noise words,
or made of noise words and words for parts of a page, or that begins with a word which names nothing else.  So
`share-buttons` and `comment-list-new` are noise and `share-price` is not.

The scanner takes time linear in the page.  Attribute values end as HTML has it: at their quote, or unquoted at white
space or `>`.

Defined cases: null or empty html gives an empty text; unclosed or stray tags are tolerated, an unclosed script,
style or comment hides the rest of the page, and a `<` whose tag never ends is text; a numeric character reference
beyond Unicode is the replacement character; very long pages are read whole; repeated rows are each extracted; a null
page_id or url stays null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re

from pyspark.sql import DataFrame

from marlstone.llm.common import map_batches, str_texts

#: Lines in the sliding window, and characters in it at a surge and at a dive.
WINDOW, SURGE, DIVE = 3, 140, 70
#: Share of a line's characters in links from which it weighs nothing: anywhere, and in an article or main element.
LINK_SHARE, MAIN_LINK_SHARE = 0.6, 0.9

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z]|/)")
_NAME = re.compile(r"[^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?|=)""")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "xmp", "noembed", "noframes", "annotation", "annotation-xml")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow mfrac msup msub msubsup msqrt mroot mtext munder mover munderover mstyle mpadded semantics".split())
#: Tags whose end may be left out, and those that an open paragraph does not reach into.
_CLOSING = frozenset("p li dt dd tr td th option".split())
_PASSED = frozenset("p td th dt dd".split())
_ENDS_PARAGRAPH = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_NOISE_TAGS = frozenset("nav footer aside form header menu dialog button head".split())
_MAIN = frozenset(("article", "main"))
_NAMED = frozenset(("class", "id", "role", "aria-label"))
#: Words that name something other than the article.
_NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsbygoogle banner sponsor sponsored promo promotion promotions nav navbar
    navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar comment comments commentlist commentform disqus reply replies
    respond discussion cookie cookies consent gdpr notice notices alert alerts popup modal newsletter subscribe subscription share sharing social related recommended
    recommendations opinions widget widgets pagination pager login signup search complementary contentinfo toolbar teaser teasers outbrain taboola""".split()
)
#: Noise words that name nothing else, whatever follows them in a name.
_LEADING_NOISE = frozenset("breadcrumb breadcrumbs comment comments commentlist cookie cookies newsletter sidebar sidebars advert advertisement advertisements pagination disqus navbar".split())
#: Words for parts of a page, which say nothing by themselves.
_PART_WORDS = frozenset(
    """site page main global primary secondary top bottom left right upper lower box block section wrap wrapper container holder list bar link links post posts story stories
    article articles entry entries item items area content contents inner outer body text title heading button buttons icon icons form panel slot unit group row col column
    module component region user users reader readers thread mobile desktop sticky fixed floating inline media policy message messages""".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{10,}|[xX][0-9a-fA-F]{10,});?")


def _decoded(text: str) -> str:
    """Character references decoded; the library's decoder does not take numbers of thousands of digits."""
    return html_lib.unescape(_LONG_REFERENCE.sub("\ufffd", text)) if "&" in text else text


def noise_name(name: str, in_main: bool = False) -> bool:
    """Whether one name of a class, id or role stands for noise; a header in the article holds its title."""
    words = [w for w in (w.lower() for w in _WORD.findall(name)) if len(w) > 2 or w == "ad"]
    named = [w for w in words if w in _NOISE_WORDS and not (in_main and w == "header")]
    return bool(named) and (words[0] in _LEADING_NOISE or all(w in _NOISE_WORDS or w in _PART_WORDS for w in words))


def _is_noise(tag: str, attributes: list[tuple[str, str]], in_main: bool) -> bool:
    """Header elements inside the article hold its title, so they count as noise only outside."""
    if tag in _NOISE_TAGS and not (tag == "header" and in_main):
        return True
    if tag in ("html", "body"):
        return False
    for name, value in attributes:
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
        if name in _NAMED and any(noise_name(x, in_main) for x in value.split()):
            return True
    return False


class _Open:
    """The open elements, with the places of each tag, of blocks and of what ends an open paragraph's reach."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # tag, began noise, is main
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.barriers: list[int] = []
        self.noise = self.mains = 0

    def links(self) -> bool:
        return bool(self.places.get("a"))

    def push(self, tag: str, noise: bool, main: bool) -> None:
        at = len(self.stack)
        self.places.setdefault(tag, []).append(at)
        if tag not in _INLINE:
            self.blocks.append(at)
            if tag not in _PASSED:
                self.barriers.append(at)
        self.noise += noise
        self.mains += main
        self.stack.append((tag, noise, main))

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, noise, main = self.stack.pop()
            self.places[tag].pop()
            for held in (self.blocks, self.barriers):
                if held and held[-1] == len(self.stack):
                    held.pop()
            self.noise -= noise
            self.mains -= main

    def end(self, tag: str) -> None:
        """An end tag: a block's closes what is open in it, an inline tag's does not reach out of its block."""
        places = self.places.get(tag)
        if places and (tag not in _INLINE or not self.blocks or places[-1] > self.blocks[-1]):
            self.close(places[-1])

    def left_out(self, tag: str) -> None:
        """The end of an element of this tag that may be left out."""
        places = self.places.get(tag)
        if places and (not self.barriers or places[-1] >= self.barriers[-1]):
            self.close(places[-1])


def _tag(html: str, at: int) -> tuple[list[tuple[str, str]], int, bool] | None:
    """(attributes, place after the tag, closes itself) of a start tag whose name ends at this place; None if it never ends."""
    found: list[tuple[str, str]] = []
    while m := _ATTRIBUTE.match(html, at):
        if m[1]:
            value = m[2] or ""
            found.append((m[1], value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0] else value))
        at = m.end()
    end = html.find(">", at)
    return None if end < 0 else (found, end + 1, html[at:end].endswith("/") or html[at - 1] == "/")


def text_lines(html: str) -> list[tuple[str, int, int, bool]]:
    """(text, weight, number of its main element or 0, lies in noise) for each block line of the page, in order."""
    lines: list[tuple[str, int, int, bool]] = []
    parts: list[str] = []
    linked = mains_seen = 0
    opened = _Open()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", _decoded("".join(parts))).strip()
            if text:
                share = MAIN_LINK_SHARE if opened.mains else LINK_SHARE
                weight = 0 if opened.noise or linked >= share * len(text) else len(text)
                lines.append((text, weight, mains_seen if opened.mains else 0, bool(opened.noise)))
            parts.clear()
        linked = 0

    at, size = 0, len(html)
    while at < size:
        m = _OPEN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            parts.append(piece)
            if opened.links():
                linked += len(_SPACE.sub(" ", _decoded(piece)).strip())
        if not m:
            break
        at, mark = m.end(), m[0]
        if mark == "<!--":
            end = html.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        if mark == "<![CDATA[":
            end = html.find("]]>", at)
            at = size if end < 0 else end + 3
            continue
        if not mark[-1].isalpha():
            end = html.find(">", at)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(html, at - 1)
        tag, ending = name[0].lower(), mark[1] == "/"
        read = _tag(html, name.end())
        if read is None:  # no tag ends from here on
            parts.append(html[m.start() :])
            break
        attributes, at, itself = read
        if tag not in _INLINE:
            flush()
        elif tag in ("br", "img", "wbr"):
            if tag == "br":
                parts.append(" ")
            continue
        if ending:
            opened.end(tag)
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else size
            continue
        if tag in _ENDS_PARAGRAPH:
            opened.left_out("p")
        if tag in _VOID or itself:
            continue
        if tag in _CLOSING:
            opened.left_out(tag)
        noise = _is_noise(tag, attributes, bool(opened.mains))
        main = tag in _MAIN and not opened.mains and not opened.noise and not noise
        mains_seen += main
        opened.push(tag, noise, main)
    flush()
    return lines


def window_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    """The sum of each window of lines, by its first line; one window where there are fewer lines."""
    total = sum(weights[:window])
    out = [total]
    for i in range(window, len(weights)):
        total += weights[i] - weights[i - window]
        out.append(total)
    return out


def stretches(weights: list[int], surge: int = SURGE, dive: int = DIVE, window: int = WINDOW) -> list[tuple[int, int]]:
    """[first, end) of the lines from each surge to its dive: a stretch begins with the first line that weighs in the window that
    surges, and ends with the last one that weighs in the window before the dive."""
    out: list[tuple[int, int]] = []
    start = None
    sums = window_sums(weights, window)
    for i, total in enumerate([*sums, -1]):
        if start is None and total >= surge:
            start = i
        elif start is not None and total < dive:
            first, last = max(start, out[-1][1] if out else 0), min(len(weights), i + window - 1)  # the window before reaches so far
            while first < last and not weights[first]:
                first += 1
            while last > first and not weights[last - 1]:
                last -= 1
            if first < last:
                out.append((first, last))
            start = None
    return out


def extract_text(html: str) -> str:
    """The main text: its blocks in page order, joined by newlines."""
    if not html:
        return ""
    lines = [x for x in text_lines(html) if not x[3]]
    kept = [line[0] for line in lines if line[2]]
    if not kept:
        found = stretches([x[1] for x in lines])
        kept = [x[0] for a, b in found for x in lines[a:b]]
        kept = kept or [line[0] for line in lines if line[1]]
    return "\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page."""

    def start():
        def each(batch):
            texts = [extract_text(h) for h in str_texts(batch.column("html"))]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    return map_batches(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", start)
