"""Cut a page into its leaf blocks of text, each with its path of elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Fixed names of the HTML standard.
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg".split())
# An opening tag ends these elements when they are still open: paragraphs, items, cells, options.
CLOSES = {name: frozenset([name]) for name in ("li", "tr", "option")}
CLOSES |= dict.fromkeys(("dt", "dd"), frozenset(["dt", "dd"])) | dict.fromkeys(("td", "th"), frozenset(["td", "th"]))
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# Attributes as the standard reads them: a quote opens a value only right behind '='; anywhere else it is a plain character.
_ATTRIBUTES = (
    r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+")
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+|\d+")


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def names(attributes: str) -> tuple[str, ...]:
    """Words of the class, id and role of a tag."""
    if "=" not in attributes:
        return ()
    return tuple(w for m in NAMES.finditer(attributes) for w in WORDS.findall((m[1] or m[2] or m[3] or "").lower()))


def blocks(page: str) -> list[Block]:
    """Blocks in page order. Text of scripts, styles and comments is none; references are decoded; white space is one space."""
    found: list[Block] = []
    open_tags: list[tuple[str, str]] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append(Block(tuple(p for _, p in open_tags if p), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def close_to(depth: int) -> None:
        del open_tags[depth:]

    while True:
        mark = TOKEN.search(page, at)
        text = page[at:mark.start() if mark else None]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if mark is None:
            break
        at = mark.end()
        tag = mark[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if mark[1] else 1
        if tag in INLINE:
            continue
        flush()
        if mark[1]:
            for depth in range(len(open_tags) - 1, -1, -1):
                if open_tags[depth][0] == tag:
                    close_to(depth)
                    break
            in_link = 0
            continue
        if tag in RAW and not mark[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ENDS_P and open_tags and open_tags[-1][0] == "p":
            open_tags.pop()
        elif tag in CLOSES and open_tags and open_tags[-1][0] in CLOSES[tag]:
            open_tags.pop()
        if tag not in VOID:
            open_tags.append((tag, " ".join((tag, *names(mark[3])))))
    flush()
    return found
