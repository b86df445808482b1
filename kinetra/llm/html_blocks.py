"""Leaf blocks of HTML pages: their text, tag path and features, without a tree in memory.

A block is the text between two block-level tags; inline tags (links, emphasis) do not part it, and a line break is white space in it.
Character references are decoded, white space becomes one space. Tags that HTML closes by itself (`p`, `li`, table cells) are
closed here, a stray end tag is ignored, and pages cut off anywhere are read as far as they go. Scripts, styles and other
elements whose content is not text of the page give no blocks. Work and memory grow with the page's length.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template title iframe textarea select svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the same family closes, up to the nearest container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot tr article aside div section nav main body".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

PATH_DIMS, WORD_DIMS, SHAPE_DIMS = 512, 128, 10


@dataclass
class Block:
    text: str
    path: str  #: names of the open elements with the words of their class, id and role, from the root; `!` before the innermost
    linked: int = 0  #: code points inside links


def _names(tag: str, attributes: str) -> str:
    names = [tag]
    if "=" in attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            names += [f"{key[0].lower()}.{p.lower()}" for p in PART.findall(next((v for v in values if v), ""))]
    return " ".join(names)


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in page order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    state = {"path": "", "linked": 0, "links": 0}

    def end_block() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append(Block(text, state["path"], state["linked"]))
        state["path"], state["linked"] = "", 0

    def text(raw: str) -> None:
        if raw:
            decoded = html.unescape(raw) if "&" in raw else raw
            if not state["path"] and not decoded.isspace():
                state["path"] = " ".join([n for _, n in stack] + ["!" + (next((t for t, _ in reversed(stack) if t not in INLINE), ""))])
            if state["links"]:
                state["linked"] += len(decoded)
            pieces.append(decoded)

    def close(k: int) -> None:
        state["links"] -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        tag = found[2] or found[6]
        if not tag:
            continue
        tag, ending = tag.lower(), found[1] or found[5]
        opened = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None) if ending else None
        if tag not in INLINE and (not ending or opened is not None or tag == "p"):
            end_block()
        elif tag == "br":
            pieces.append(" ")
        if ending:
            if opened is not None:
                close(opened)
            continue
        attributes = found[3] or found[7] or ""
        if tag in UNSEEN:
            if not attributes.endswith("/"):
                finish = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = finish.end() if finish else size
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), None)
            if k is not None and not any(t in CONTAINERS for t, _ in stack[k:]):
                close(k)
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(tag, ()):
                close(k)
                if tag != "tr":
                    break
            elif stack[k][0] in CONTAINERS and not (tag in ("tr", "td", "th") and stack[k][0] == "tr" and tag == "tr"):
                break
        stack.append((tag, _names(tag, attributes)))
        state["links"] += tag == "a"
    end_block()
    return out


class _WordNumbers(dict):
    """Hashed numbers of words, kept as they are asked for."""

    def __missing__(self, word: str) -> int:
        found = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % WORD_DIMS
        return found


class Features:
    """Numbers of blocks: hashed tag paths, hashed words and shape. Paths and words that were seen are kept, up to a bound."""

    MAX_HELD = 300_000

    def __init__(self) -> None:
        self.paths: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.words = _WordNumbers()

    def path_id(self, path: str) -> int:
        found = self.paths.get(path)
        if found is None:
            row = np.zeros(PATH_DIMS, dtype=np.float32)
            for name in set(path.split(" ")):
                row[zlib.crc32(name.encode()) % PATH_DIMS] = 1
            found = self.paths[path] = len(self.rows)
            self.rows.append(row)
        return found

    def forget(self) -> None:
        """Called between batches of pages; numbers of paths are good until then."""
        if len(self.words) > self.MAX_HELD:
            self.words.clear()
        if len(self.rows) > 5_000:
            self.paths.clear()
            self.rows.clear()

    def word_ids(self, text: str) -> list[int]:
        return [*map(self.words.__getitem__, text.lower().split())]

    def page(self, blocks: list[Block]) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
        """(path number of each block, hashed words of each, shape of each)."""
        ids = [self.word_ids(b.text) for b in blocks]
        chars = np.array([len(b.text) for b in blocks], dtype=np.float32)
        words = np.array([len(w) for w in ids], dtype=np.float32)
        linked = np.minimum(np.array([b.linked for b in blocks], dtype=np.float32), chars) / chars
        ends = np.array([b.text[-1] in ".!?…:;”\"" for b in blocks], dtype=np.float32)
        marks = np.array([b.text.count(",") + b.text.count(".") for b in blocks], dtype=np.float32)
        n = len(blocks)
        place = np.arange(n, dtype=np.float32)
        shape = np.stack([np.log1p(words) / 5, np.log1p(chars) / 7, linked, ends, np.minimum(marks / words, 1), chars / words / 10, place / n, np.minimum(place, 10) / 10, np.minimum(n - 1 - place, 10) / 10, np.full(n, np.log1p(n) / 5)], axis=1) if n else np.zeros((0, SHAPE_DIMS))
        return np.array([self.path_id(b.path) for b in blocks], dtype=np.int64), ids, shape.astype(np.float32)
