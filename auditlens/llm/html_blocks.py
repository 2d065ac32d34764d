"""Web pages to sequences of text blocks with features: tag path, hashed words, a few measures."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import numpy as np

from auditlens.llm.vectors import words

TAG = re.compile(r"""<!--.*?-->|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECE = re.compile(r"[a-z]+")
#: Elements whose content is raw text by the HTML standard, up to their end tag or the page's end, and no text of the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements with markup inside that is no text of the page. Without an end tag of its own such an element leaves nothing out, but
#: an option, which may have none, ends where the next block begins.
HIDDEN = frozenset("noscript template svg select button option".split())
#: Elements that stay inside a block.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag ends, if it is open and innermost.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
PATH, OWN, WORDS, MEASURES = 48, 16, 16, 7
WIDTH = PATH + OWN + WORDS + MEASURES
SPACES = re.compile(r"[\s\x1c-\x1f]+")

_VECTORS: dict[tuple[str, int], np.ndarray] = {}


def _vector(token: str, width: int) -> np.ndarray:
    """Three signed places of a token."""
    held = _VECTORS.get((token, width))
    if held is None:
        if len(_VECTORS) > 20_000:
            _VECTORS.clear()
        held = np.zeros(width, np.float32)
        for k in range(3):
            h = zlib.crc32(f"{k}{token}".encode("utf-8", "replace"))
            held[h % width] += 1 if h & 0x10000 else -1
        _VECTORS[token, width] = held
    return held


def _names(name: str, attributes: str) -> list[str]:
    found = [f"<{name}>"]
    if "=" in attributes:
        for m in NAMES.finditer(attributes):
            found += PIECE.findall((m[1] or m[2] or m[3] or "").lower())
    return found


class _Page:
    def __init__(self) -> None:
        #: Name, path, own vector, and the number of blocks before it.
        self.stack: list[tuple[str, np.ndarray, np.ndarray, int]] = [("", np.zeros(PATH, np.float32), np.zeros(OWN, np.float32), 0)]
        self.held: Counter[str] = Counter()
        self.blocks: list[tuple[str, int, np.ndarray, np.ndarray]] = []
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False

    def text(self, raw: str) -> None:
        if raw:
            if "&" in raw:
                raw = html.unescape(raw)
            self.parts.append(raw)
            if self.in_link:
                self.linked += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = SPACES.sub(" ", "".join(self.parts)).strip(" ")
            if text:
                self.blocks.append((text, min(self.linked, len(text)), self.stack[-1][1], self.stack[-1][2]))
            self.parts, self.linked = [], 0
        self.in_link = False

    def open(self, name: str, attributes: str) -> None:
        self.flush()
        ends = {"option"} if name in HIDDEN else ENDS.get(name, {"p"}) | {"option"}
        while self.stack[-1][0] in ends:
            self.pop()
        if name in VOID:
            return
        path, own = self.stack[-1][1:3]
        if name not in HIDDEN:  # no mark on what it may hold for want of an end tag
            path, own = path.copy(), np.zeros(OWN, np.float32)
            for token in _names(name, attributes):
                path += _vector(token, PATH)
                own += _vector(token, OWN)
        self.stack.append((name, path, own, len(self.blocks)))
        self.held[name] += 1

    def pop(self, ended: str = "") -> str:
        """Take the innermost element off; what is in a hidden one that its own tag has `ended` goes, as does the text of an option."""
        name, _, _, first = self.stack.pop()
        self.held[name] -= 1
        if name == "option" or name == ended and name in HIDDEN:
            del self.blocks[first:]
        return name

    def close(self, name: str) -> None:
        self.flush()
        if self.held[name]:
            while self.pop(name) != name:
                pass

    def end(self) -> None:
        self.flush()
        if self.stack[-1][0] == "option":
            self.pop()


def blocks_of(page: str) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(text, linked characters, path vector, own vector) of every text block in page order.

    References are decoded, white space becomes one space. Comments, declarations and elements that show no text are skipped;
    tags left open are ended by those that cannot stand in them, and a mark that is no tag is text.
    """
    out, at, n = _Page(), 0, len(page)
    last = page.rfind(">")
    while at < n:
        m = TAG.search(page, at, last + 1) if at <= last else None
        if m is None:
            out.text(page[at:])
            break
        out.text(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                out.in_link = False
            elif name not in INLINE and name not in VOID:
                out.close(name)
        elif name in RAW and not m[3].endswith("/"):
            out.flush()
            ends = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = ends.end() if ends else n
        elif name == "svg" and m[3].endswith("/") or m[3].endswith("/") and out.held["svg"]:
            out.flush()
        elif name == "a":
            out.in_link = True
        elif name == "br":
            out.text(" ")
        elif name not in INLINE:
            out.open(name, m[3])
    out.end()
    return out.blocks


def features(pages: list[list[tuple[str, int, np.ndarray, np.ndarray]]]) -> list[np.ndarray]:
    """For every page a row per block: its path, its own tag, all its words hashed, its measures."""
    blocks = [b for page in pages for b in page]
    if not blocks:
        return [np.zeros((0, WIDTH), np.float32) for _ in pages]
    out = np.zeros((len(blocks), WIDTH), np.float32)
    out[:, :PATH] = np.clip(np.stack([b[2] for b in blocks]), -4, 4)
    out[:, PATH:PATH + OWN] = np.clip(np.stack([b[3] for b in blocks]), -8, 8)
    hashes, owner, counts = words([b[0].encode("utf-8", "replace") for b in blocks])
    held = np.bincount(owner * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=len(blocks) * WORDS).reshape(-1, WORDS)
    out[:, PATH + OWN:PATH + OWN + WORDS] = held / np.maximum(1, counts)[:, None]
    own = np.array([(len(t), linked, t.count(".") + t.count(","), t[-1] in ".!?:;\"'") for t, linked, _, _ in blocks], np.float32)
    sizes = [len(page) for page in pages]
    place = np.concatenate([np.arange(n) for n in sizes]).astype(np.float32)
    of = np.repeat(sizes, sizes)
    out[:, -MEASURES:] = np.stack([np.log1p(own[:, 0]) / 8, own[:, 1] / own[:, 0], np.log1p(counts) / 6, own[:, 2] / own[:, 0] * 10,
                                   own[:, 3], place / of, 1 / (1 + place)], axis=1)
    return np.split(out, np.cumsum(sizes)[:-1])
