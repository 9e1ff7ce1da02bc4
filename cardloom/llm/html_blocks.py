"""HTML cut into blocks of text, and the vectors that the block labeller reads."""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Element names of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split()
)
#: Elements without text of the page; their content is skipped whole.
OPAQUE = frozenset("script style noscript template iframe svg object audio video canvas textarea select annotation".split())
#: Of these, the ones that run to the end of the page if they aren't closed; the others end at their own tag then.
RAW = frozenset("script style textarea".split())
#: Of these, the ones that a slash in the tag closes.
FOREIGN = frozenset("svg annotation".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: The same where a quote isn't closed.
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
CLOSED = {name: re.compile(rf"</{name}\s*>", re.I) for name in OPAQUE}
NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[A-Za-z]+")

TAGS, NAMES, TEXT, NUMBERS = 96, 256, 32, 16
WIDTH = TAGS + NAMES + TEXT + NUMBERS


# Words by which pages in four languages head or label what is not the article.
SPARE_WORDS = frozenset(
    "comments comment reply replies kommentare kommentar antworten commentaires commentaire répondre comentarios comentario responder "
    "related share subscribe newsletter login cookies cookie advertisement sponsored anzeige werbung publicité publicidad copyright © menu home search suche recherche buscar "
    "impressum datenschutz privacy terms contact kontakt mentions légales aviso legal tags popular trending recommended".split()
)


class Node:
    """An element that is no inline one, and the elements around it; blocks share the nodes of their paths."""

    __slots__ = ("tag", "names", "parent", "counts", "chars", "linked")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None):
        self.tag, self.names, self.parent = tag, names, parent
        self.counts: np.ndarray | None = None if parent else np.zeros(TAGS + NAMES, np.uint8)
        self.chars = self.linked = 0  # of all blocks inside, once the page is cut

    def hashed(self) -> np.ndarray:
        """How often each slot is met on the path, 3 at most."""
        chain, node = [], self
        while node.counts is None:
            chain.append(node)
            node = node.parent
        own = node.counts
        for node in reversed(chain):
            own = own.copy()
            for k in (slot("<" + node.tag, TAGS), *(TAGS + slot(n, NAMES) for n in node.names)):
                own[k] = min(3, own[k] + 1)
            node.counts = own
        return own


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """Tag and names of each element around, outermost first."""
        out, node = [], self.node
        while node.parent:
            out.append((node.tag, node.names))
            node = node.parent
        return tuple(reversed(out))


def names_of(attributes: str) -> tuple[str, ...]:
    """Words of class, id and the like, in lower case."""
    found = []
    for m in NAMED.finditer(attributes):
        found += [w.lower() for w in WORDS.findall(m[1] or m[2] or m[3] or "")]
    return tuple(found)


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """``start, end, name, closing, attributes`` of the markup in a page, the name empty for what is no element; the one that reads it may send a place to go on from.

    Each character is looked at a bounded number of times: what has no ``>`` behind it is text, and after a quote that runs to the end of the page quotes hide nothing any more.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while 0 <= (start := page.find("<", at)) < last:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            found = start, len(page) if end < 0 else end + 3, "", False, ""
        elif page.startswith(("<!", "<?"), start):
            found = start, page.index(">", start) + 1, "", False, ""
        else:
            m = TAG.match(page, start) if quotes else None
            if not m and (m := LOOSE_TAG.match(page, start)):
                quotes = False
            if not m:
                at = start + 1
                continue
            found = start, m.end(), m[2].lower(), bool(m[1]), m[3]
        at = found[1]
        at = (yield found) or at


def cut(page: str | None) -> list[Block]:
    """Blocks in page order.  Inline elements don't end a block; a paragraph ends where the next block element begins.

    Work and memory grow with the page, however deep its elements lie in each other and whatever isn't closed.
    """
    page = page or ""
    out: list[Block] = []
    root = Node("", (), None)
    nodes = [root]
    stack: list[tuple[str, Node]] = []  # open elements; an inline one has the node around it
    open_: Counter[str] = Counter()
    inline: list[Counter[str]] = [Counter()]  # open inline elements since each open block element
    held: list[str] = []
    linked = at = 0

    def close():
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(Block(stack[-1][1] if stack else root, text, linked))
        linked = 0

    def pop(size: int):
        while len(stack) > size:
            name = stack.pop()[0]
            open_[name] -= 1
            if name in INLINE:
                inline[-1][name] -= 1
            else:
                inline.pop()

    unclosed: set[str] = set()  # names without an end tag from here on, so that none is looked for twice
    found, goto = tags(page), None
    while True:
        try:
            start, end, name, closing, attributes = found.send(goto) if goto is not None else next(found)
        except StopIteration:
            break
        goto = None
        if start > at:
            held.append(page[at:start])
            if open_["a"]:
                linked += start - at
        at = end
        if not name:
            continue
        if name in OPAQUE:  # ends nothing inside a sentence, but is no text
            held.append(" ")
            if not (closing or name in unclosed or name in FOREIGN and attributes.endswith("/")):
                if m := CLOSED[name].search(page, at):
                    at = goto = m.end()
                elif name in RAW:
                    at = len(page)
                    break
                else:
                    unclosed.add(name)
            continue
        if name not in INLINE:
            close()
        if closing:
            if inline[-1][name] if name in INLINE else open_[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        pop(i)
                        break
        elif name not in VOID:
            if name not in INLINE:
                while stack and stack[-1][0] in INLINE:
                    pop(len(stack) - 1)
                if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    pop(len(stack) - 1)
            around = stack[-1][1] if stack else root
            if name in INLINE:
                inline[-1][name] += 1
            else:
                around = Node(name, names_of(attributes), around)
                nodes.append(around)
                inline.append(Counter())
            stack.append((name, around))
            open_[name] += 1
    if at < len(page):
        held.append(page[at:])
    close()
    for b in out:
        b.node.chars += len(b.text)
        b.node.linked += min(b.linked, len(b.text))
    for node in reversed(nodes[1:]):  # elements inside come after those around them
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    return out


_SLOTS: dict[tuple[str, int], int] = {}


def slot(word: str, size: int) -> int:
    """A word's place in a vector; kept for the words that come often."""
    key = word, size
    if key not in _SLOTS:
        if len(_SLOTS) > 200_000:
            _SLOTS.clear()
        _SLOTS[key] = zlib.crc32(word.encode()) % size
    return _SLOTS[key]


def vectors(blocks: list[Block], start: int = 0, end: int | None = None, before: int = 0) -> np.ndarray:
    """One row for each of the page's blocks from ``start`` to ``end``: hashed tag path, hashed names on the path, hashed words of the whole text, and sixteen numbers, among them how much of
    the page's text lies in the element, and in the two around it, and how much of that in links.  ``before`` is the number of characters in front of ``start``."""
    end = len(blocks) if end is None else end
    out = np.zeros((end - start, WIDTH), np.float32)
    total = 1
    if blocks:
        top = blocks[0].node
        while top.parent:
            top = top.parent
        total = top.chars or 1
    for i in range(start, end):
        b, row = blocks[i], out[i - start]
        node = b.node
        row[: TAGS + NAMES] = node.hashed()
        if node.parent:
            row[slot("." + node.tag, TAGS)] += 1
        words = b.text.lower().split(" ")
        np.add.at(row, [TAGS + NAMES + slot(w, TEXT) for w in words], 1 / len(words))
        n = len(b.text)
        around = node.parent or node
        wide = around.parent or around
        last = blocks[i - 1].node if i else None
        row[-NUMBERS:] = (
            math.log1p(n) / 8,
            math.log1p(len(words)) / 6,
            min(1.0, b.linked / n),
            b.text[-1] in ".!?",
            min(1.0, 10 * sum(map(b.text.count, ".,;:!?")) / n),
            before / total,
            (i + 1) / len(blocks),
            n / total,
            node.chars / total,
            around.chars / total,
            wide.chars / total,
            around.linked / (around.chars or 1),
            wide.linked / (wide.chars or 1),
            last is not None and last.parent is node.parent,
            any(w.strip(".,:;()[]") in SPARE_WORDS for w in words) if len(words) < 12 else 0.0,
            1 / (1 + math.log1p(len(blocks))),
        )
        before += n
    np.minimum(out[:, : TAGS + NAMES], 3, out=out[:, : TAGS + NAMES])
    return out
