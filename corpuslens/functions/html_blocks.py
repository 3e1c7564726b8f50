"""Small HTML helper for the page UDF: one pass, no tree kept.

Emits the text blocks of a page in document order. Everything after that
(whitespace, headings, sections, flags) is Spark column work.
"""

from __future__ import annotations

from html.entities import html5
from html.parser import HTMLParser

from corpuslens import fixed_values as fv

VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
# Text in these never counts as page text.
SILENT = frozenset(["script", "style", "template", "rt", "rp"])
DROPPED = frozenset(fv.DROPPED_ELEMENTS)
BLOCKS = frozenset(fv.BLOCK_ELEMENTS)


class _Block:
    """A block, heading, table row, link or title that is still collecting text."""

    def __init__(self, tag: str, silent: bool):
        self.tag, self.silent = tag, silent
        self.href = None
        self.pieces: list[str] = []        # own text nodes
        self.cells: list[_Block] = []      # th/td of a table row
        self.lists = 0                     # open ul/ol inside a list item


class PageScan(HTMLParser):
    """Lenient nesting: an end tag closes its nearest open element and all
    inside it; one without an open element is ignored; void tags hold nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack: list[tuple[str, list[_Block]]] = []
        self.open_tags: dict[str, int] = {}
        self.outside: dict[str, int] = {}  # tags open around <main>
        self.main_depth = None
        self.saw_main = False
        self.collecting: list[_Block] = []
        self.blocks: list[_Block] = []
        self.links: list[_Block] = []
        self.h1 = None
        self.title = None
        self.text: list[str] = []          # all text, for dates
        self.parts: list[str] = [""]       # current text node, split at stray end tags

    # --- text ---------------------------------------------------------------
    def handle_data(self, data):
        self.parts[-1] += data

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            # Numeric references 128..159 mean windows-1252 characters.
            char = bytes([code]).decode("cp1252", "replace") if 128 <= code < 160 else chr(code)
        except (ValueError, OverflowError):
            char = "�"
        self.parts[-1] += char

    def handle_entityref(self, name):
        self.parts[-1] += html5.get(name + ";", "&" + name)

    def _text_end(self):
        parts, self.parts = self.parts, [""]
        if parts == [""] or any(self.open_tags.get(t) for t in SILENT):
            return
        whole = "".join(parts).strip()
        for piece in (p.strip() for p in parts):
            if piece:
                self.text.append(piece)
        if not whole:
            return
        dropped = self._within(DROPPED)
        for b in self.collecting:
            if b.silent:                   # title, h1, links: read before anything is dropped
                b.pieces.extend(p.strip() for p in parts if p.strip())
            elif not dropped and not b.lists:
                b.pieces.append(whole)

    # --- structure ------------------------------------------------------------
    def _within(self, tags):
        return any(self.open_tags.get(t, 0) > self.outside.get(t, 0) for t in tags)

    def _collect(self, tag, silent, owner):
        b = _Block(tag, silent)
        self.collecting.append(b)
        owner.append(b)
        return b

    def handle_starttag(self, tag, attrs):
        self._text_end()
        owned: list[_Block] = []
        if tag == "main" and not self.saw_main:
            # Only the first <main> counts: forget what was seen outside it.
            self.saw_main, self.main_depth = True, len(self.stack)
            self.outside = dict(self.open_tags)
            self.blocks, self.links, self.h1, self.text = [], [], None, []
            self.collecting = [b for b in self.collecting if b.tag == "title"]
        closed = self.saw_main and self.main_depth is None
        if tag == "title" and self.title is None:
            self.title = self._collect(tag, True, owned)
        if not closed:
            self._open_block(tag, dict(attrs), owned)
        if tag in ("ul", "ol"):
            for b in self.collecting:
                b.lists += b.tag == "li" and not b.silent
        if tag in VOID:
            self._release(owned)
            return
        self.stack.append((tag, owned))
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def _open_block(self, tag, attrs, owned):
        if tag == "h1" and self.h1 is None:
            self.h1 = self._collect(tag, True, owned)
        if tag == "a" and "href" in attrs:
            link = self._collect(tag, True, owned)
            link.href = attrs["href"] or ""
            self.links.append(link)
        if self._within(DROPPED):
            return
        if tag in ("th", "td"):
            for row in [b for b in self.collecting if b.tag == "tr"]:
                row.cells.append(self._collect(tag, False, owned))
        if tag not in BLOCKS:
            return
        if tag in ("p", "li", "blockquote") and self._within(("table",)):
            return
        if tag == "p" and self._within(("li",)):
            return
        self.blocks.append(self._collect(tag, False, owned))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open_tags.get(tag):
            self.parts.append("")          # stray end tag: same text node once cleaned
            return
        self._text_end()
        while True:
            name, owned = self.stack.pop()
            self.open_tags[name] -= 1
            self._release(owned)
            if name in ("ul", "ol"):
                for b in self.collecting:
                    b.lists -= b.tag == "li" and not b.silent
            if self.main_depth == len(self.stack):
                self.main_depth = None     # <main> is over
                self.collecting = [b for b in self.collecting if b.tag == "title"]
                self.text_done, self.text = self.text, []
            if name == tag:
                return

    def _release(self, owned):
        if owned:
            self.collecting = [b for b in self.collecting if b not in owned]

    def handle_comment(self, data):
        self._text_end()

    def handle_decl(self, decl):
        self._text_end()

    def handle_pi(self, data):
        self._text_end()

    def unknown_decl(self, data):
        self._text_end()

    def finish(self):
        self.close()
        self._text_end()
        if self.saw_main and self.main_depth is None:
            self.text = self.text_done
        return self


def _joined(block: _Block | None) -> str | None:
    return None if block is None else " ".join(block.pieces)


def scan_page(html: str) -> dict:
    """Title, text, blocks and links of one page, in document order."""
    page = PageScan()
    page.feed(html)
    page.finish()
    heading = page.h1 if page.h1 is not None else page.title
    return {
        "title": _joined(heading),
        "full_text": " ".join(page.text),
        "blocks": [
            {
                "tag": b.tag,
                "cells": [_joined(c) for c in b.cells] if b.tag == "tr" else [_joined(b)],
            }
            for b in page.blocks
        ],
        "links": [{"href": b.href, "label": _joined(b)} for b in page.links],
    }
