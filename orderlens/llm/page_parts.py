"""Elements and text runs of one HTML page, read leniently; used page by page in the executors."""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

# Element names by their part in a page, after the HTML standard.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "basefont", "col", "embed", "frame", "img", "input", "link", "meta", "param", "source", "track"}
SPACE = {"br", "td", "th"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "canvas", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "math", "menu",
         "nav", "object", "ol", "option", "p", "pre", "search", "section", "select", "summary", "svg", "table", "tbody", "template", "tfoot", "thead",
         "tr", "ul", "video", "audio"}
PROSE = {"blockquote", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "tr"}
#: Elements that end an open one of the same kind, and the containers that keep it open.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "option": ({"option"}, {"select"})}
#: A paragraph stays open only beneath inline elements; a block's start ends it.
KEEPS_P = {"option", "button"}

# What no article holds, by element, role and words of class or id.
APART = {"aside", "audio", "button", "canvas", "dialog", "fieldset", "footer", "form", "math", "menu", "nav", "object", "option", "search", "select", "svg",
         "template", "video"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
WORDS = {"ad", "ads", "advert", "advertisement", "advertising", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
         "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
         "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "share", "sharing",
         "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets"}
STEMS = ("advert", "breadcrumb", "comments", "cookie", "newsletter", "sidebar", "sponsor")
#: Names that an article goes by where no element says so, the surest first.
NAMES = ({"articlebody"}, {"article"}, {"post", "entry", "story"}, {"content", "main"})

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_TAG = re.compile(r"</?[A-Za-z]")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _apart_by(names: set[str]) -> bool:
    return bool(names & WORDS) or any(n.startswith(STEMS) for n in names)


class Page:
    """Elements in page order (tag, parent, names, apart, digest), the article's elements (main) and text runs
    (element, block, text, linked)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.names, self.apart, self.digest = ["body"], [-1], [frozenset()], [False], [0]
        self.runs: list[tuple[int, int, str, bool]] = []
        self._read(html)
        self.main = self._main()
        main = set(self.main)
        self.inside = self._below([i in main for i in range(len(self.tag))])
        self._spare()

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        names, apart = set(), tag in APART
        for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
            key, value = key.lower(), a or b or c
            if key in ("class", "id", "itemprop"):
                words = [w.lower() for w in _NAME.findall(value)]
                names.update(words)
                names.update(x + y for x, y in zip(words, words[1:]))
            elif key == "role":
                apart = apart or value.lower() in ROLES
                names.update({"main", "article"} & {value.lower()})
            elif key in ("hidden", "aria-hidden", "style"):
                apart = apart or key == "hidden" or value.lower() == "true" or key == "style" and bool(_HIDDEN.search(value))
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(frozenset(names))
        self.apart.append(apart or tag not in ("article", "main") and _apart_by(names))
        self.digest.append(0)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack, hashes, at, block, linked, text = [0], [blake2b(b"body", digest_size=8)], 0, 0, False, []

        def flush(ends: bool = True) -> None:
            nonlocal block
            if text:
                joined = unescape("".join(text))
                text.clear()
                if joined.strip():
                    self.runs.append((stack[-1], block, joined, linked))
                    hashes[-1].update(b"\0" + " ".join(joined.split()).encode("utf-8", "replace"))
                    self.digest[stack[-1]] = 1
                elif self.runs and not ends:
                    self.runs.append((stack[-1], block, " ", linked))
            block += ends

        def close(keep: int) -> None:
            """Elements from place ``keep`` of the stack on end; 64-bit hashes of their tags, texts and children, 0 without text."""
            while len(stack) > keep:
                element, h = stack.pop(), hashes.pop()
                if self.digest[element]:
                    self.digest[element] = int.from_bytes(h.digest(), "little", signed=True) or 1
                    if hashes:
                        hashes[-1].update(b"\1" + h.digest())
                        self.digest[stack[-1]] = 1

        while (start := html.find("<", at)) >= 0:
            if start > at:
                text.append(html[at:start])
            m = _TOKEN.match(html, start)
            if not m:  # not a tag, or one without an end
                if _TAG.match(html, start):
                    end = html.find(">", start)
                    at = len(html) if end < 0 else end + 1
                else:
                    text.append("<")
                    at = start + 1
                continue
            at, tag = m.end(), (m[2] or "").lower()
            if tag in SPACE:
                text.append(" ")
            elif tag == "a":
                flush(False)
                linked = not m[1]
            elif tag == "hr" or tag == "body":
                flush()
            elif m[1] and tag in BLOCK:
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[i]] == tag:
                        close(i)
                        break
            elif tag in RAW and not m[1]:
                end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(html, at)
                at = end.start() if end else len(html)
            elif tag in BLOCK:
                flush()
                linked = False
                if self.tag[stack[-1]] == "p" and tag not in KEEPS_P:
                    close(len(stack) - 1)
                same, holds = SIBLINGS.get(tag, ((), ()))
                for i in range(len(stack) - 1, 0, -1) if same else ():
                    if self.tag[stack[i]] in holds:
                        break
                    if self.tag[stack[i]] in same:
                        close(i)
                        break
                stack.append(self._open(tag, m[3], stack[-1]))
                hashes.append(blake2b(tag.encode(), digest_size=8))
        text.append(html[at:])
        flush()
        close(0)

    def _below(self, marked: list[bool]) -> list[bool]:
        for i in range(1, len(marked)):
            marked[i] = marked[i] or marked[self.parent[i]]
        return marked

    def _sizes(self, counted: list[bool], linked: bool = False) -> list[int]:
        """Characters of text in each element, of links only if ``linked``."""
        size = [0] * len(self.tag)
        for element, _, text, link in self.runs:
            if counted[element] and (link or not linked):
                size[element] += len(text.strip())
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        return size

    def _main(self) -> list[int]:
        """The elements that hold the article, or the body.  A wrapper of an article that holds most of the page isn't apart."""
        size = self._sizes([True] * len(self.tag))
        holds = [t in ("article", "main") for t in self.tag]
        for i in range(len(holds) - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        for i in range(1, len(holds)):
            if holds[i] and 2 * size[i] >= size[0]:
                self.apart[i] = False
        away = self._below(list(self.apart))
        for wanted in ("article", "main"):
            found = [i for i, t in enumerate(self.tag) if t == wanted and not away[i]]
            if found:
                inside = self._below([t == wanted for t in self.tag])
                return [i for i in found if not inside[self.parent[i]]]
        size = self._sizes([not a for a in away])
        for names in NAMES:
            for i in range(1, len(size)):
                if self.names[i] & names and not away[i] and 2 * size[i] >= size[0] > 0:
                    return [i]
        return [0]

    def _spare(self) -> None:
        """Elements around the article aren't apart; a header outside it is the site's; without an article, lists of links are menus."""
        for i in self.main:
            while i >= 0:
                self.apart[i], i = False, self.parent[i]
        around = {0}
        for i in self.main:
            while i > 0:
                around.add(i)
                i = self.parent[i]
        whole = self.main == [0]
        for i, t in enumerate(self.tag):
            if (t == "header" or "header" in self.names[i]) and i not in around and (whole or not self.inside[i]):
                self.apart[i] = True
        if whole:
            every, links = self._sizes([True] * len(self.tag)), self._sizes([True] * len(self.tag), linked=True)
            for i, t in enumerate(self.tag):
                if t in ("ul", "ol") and every[i] and 5 * links[i] >= 4 * every[i]:
                    self.apart[i] = True

    def subtrees(self) -> list[int]:
        """Digests of the elements with text, but for the body and the article itself."""
        return [d for i, d in enumerate(self.digest) if d and i and i not in self.main]

    def blocks(self, often: frozenset = frozenset(), mostly: frozenset = frozenset()) -> list[str]:
        """The article's blocks.  ``often`` has digests of subtrees that recur on pages of the host, which go where they
        can't be the article's; ``mostly`` those that most of its pages have, which go unless they are prose of a declared article."""
        gone = list(self.apart)
        for i, d in enumerate(self.digest):
            if d in mostly or d in often:
                prose, whole = self.tag[i] in PROSE, self.main == [0]
                theirs = (prose and not whole) if d in mostly else (prose or not whole)
                gone[i] = gone[i] or not (theirs and self.inside[i])
        for i in (0, *self.main):
            while i >= 0:
                gone[i], i = False, self.parent[i]
        gone = self._below(gone)
        out, last = [], None
        for element, block, text, _ in self.runs:
            if self.inside[element] and not gone[element]:
                if block == last:
                    out[-1] += text
                else:
                    out.append(text)
                last = block
        return [b for b in (" ".join(x.split()) for x in out) if b]
