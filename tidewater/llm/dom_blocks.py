"""Leaf blocks of an HTML page: their texts, and features of their ancestors, their place and their words.

A block is the text between two borders of block elements.  Void and inline tags don't end a block (a line break is white
space).  Open elements are kept on a stack; start tags end what HTML lets them end (a paragraph by any block, an item by the
next item), end tags without a start are passed over, and what is left open ends with the page.  One pass, whatever is broken.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Container, Iterable
from dataclasses import dataclass

#: Fixed values of HTML: elements that end the text before them, elements without content, elements whose content is no text.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
search section select summary table tbody td textarea tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = frozenset("iframe noembed noframes noscript object script style svg template".split())
#: What a start tag ends, if it is open inside the nearest element of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
        "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"})}
#: Elements that an end tag of something else does not reach across, but for those of a table's parts.
WALLS = ("td", "th", "table", "caption", "button")
ROWS = frozenset({"table", "tbody", "tfoot", "thead", "tr"})

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)""",
                    re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]*$")


@dataclass
class Block:
    text: str
    #: Features that all blocks of the same open elements share, and the block's own.
    around: tuple[str, ...]
    own: list[str]


def _name_parts(attributes: str) -> list[str]:
    """Features of an element's class, id, role and itemprop: their words, and the first five letters of those."""
    out = []
    for m in _NAMES.finditer(attributes):
        for word in _PART.findall(m[1] or m[2] or m[3] or ""):
            w = word.lower()
            out += ["n:" + w, "s:" + w[:5]]
    return out


def _own(text: str, letters: int, linked: int, tag: str, before: str) -> list[str]:
    words = _WORD.findall(text[:200].lower())
    n = min(len(text).bit_length(), 9)
    share = min(3, 4 * linked // max(1, letters))
    ends = bool(_SENTENCE.search(text[-4:]))
    out = ["all", f"tag:{tag}", f"len:{n}", f"link:{share}", f"end:{ends}", f"len-end:{n}{ends}", f"tag-end:{tag}{ends}",
           f"after:{before}"]
    if len(words) <= 12:
        out += ["w:" + w for w in words]
    out.append("first:" + (text[0] if not text[0].isalnum() else "a"))
    return out


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The page's blocks with text, in order.  ``known``: keep only these features of open elements (bounds their number)."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = [("", ())]
    depths: dict[str, list[int]] = {}
    pieces: list[str] = []
    letters = linked = at = 0
    link_depth = 0  # of the stack where a link began; 0: none
    before = ""

    def flush() -> None:
        nonlocal letters, linked, before
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                tag = stack[-1][0]
                out.append(Block(text, stack[-1][1], _own(text, letters, linked, tag, before)))
                before = tag
        letters = linked = 0

    def close(depth: int) -> None:
        nonlocal link_depth
        while len(stack) > depth:
            depths[stack.pop()[0]].pop()
        if link_depth > len(stack):
            link_depth = 0

    def nearest(names: Iterable[str], walls: Iterable[str]) -> int:
        """Depth of the nearest open element of the names, if no wall stands nearer; 0: none."""
        found = max((depths[x][-1] for x in names if depths.get(x)), default=0)
        return found if found and found >= max((depths[x][-1] for x in walls if depths.get(x)), default=0) else 0

    def text_until(end: int) -> None:
        nonlocal letters, linked
        if end > at:
            piece = page[at:end]
            if "&" in piece:
                piece = entities.unescape(piece)
            pieces.append(piece)
            n = len(piece) - piece.count(" ")
            letters += n
            if link_depth:
                linked += n

    while m := _TOKEN.search(page, at):
        text_until(m.start())
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if name == "a":
                link_depth = 0
            elif name == "br":
                pieces.append(" ")
            elif name in BLOCK:
                flush()
                if depth := nearest((name,), () if name in ROWS else WALLS):
                    close(depth)
            continue
        if name in NO_TEXT:
            if not m[3].endswith("/>") or name != "svg":
                end = re.compile(f"</{name}(?=[\\s/>])[^>]*+(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name == "a":
            link_depth = len(stack)
        elif name in BLOCK:
            flush()
            if depth := nearest(("p",), WALLS):
                close(depth)
            if name in ENDS and (depth := nearest(*ENDS[name])):
                close(depth)
            if name not in VOID:
                above = stack[-1][1]
                new = [f for f in ("t:" + name, *_name_parts(m[3])) if f not in above and (known is None or f in known)]
                stack.append((name, (*above, *dict.fromkeys(new)) if new else above))
                depths.setdefault(name, []).append(len(stack) - 1)
        elif name in VOID:
            pieces.append(" " if name == "br" else "")
    text_until(len(page))
    flush()
    return out
