"""Pages read once from front to back: visible text, title, language and links.

Every search goes on from where the last one ended, expressions never go back,
and what is missing is not looked for again, so that time follows the length of
a page whatever stands in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements whose content is not shown.
HIDDEN = frozenset("script style noscript template svg".split())
#: Elements that start and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section "
    "table tbody td tfoot th thead title tr ul".split()
)

#: A comment's opening, or a whole tag: slash, name, attributes.
_TAG = re.compile(r"<!--|<(?:(/?)([A-Za-z][A-Za-z0-9:-]*+)|[!?])([^>]*+)>")
_CLOSERS = {name: re.compile(f"</{name}[^>]*+(?:>|\\Z)", re.I | re.A) for name in HIDDEN}
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s=/]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|(\S*+)))?")
_BLANK = re.compile(r"[^\S\n]+")
_LONG_NUMBER = re.compile(r"&#(?:0*+[1-9][0-9]{7,}|[xX]0*+[1-9A-Fa-f][0-9A-Fa-f]{6,});?")


class _Closer:
    """Finds the end of an element, ever further on; remembers that there is none any more."""

    def __init__(self, page: str, name: str):
        self.page, self.mark, self.none = page, _CLOSERS[name], False

    def after(self, place: int) -> int:
        """Behind the element that is open at place; the page's length if it does not end."""
        found = None if self.none else self.mark.search(self.page, place)
        self.none = found is None
        return len(self.page) if found is None else found.end()


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content) in order: text, open and close tags with their attributes, hidden content.

    Up to the last ``>`` of the page every tag that opens ends, so that none is
    looked through twice.
    """
    last, closers = page.rfind(">") + 1, {}
    at = 0
    while (m := _TAG.search(page, at, last)) is not None:
        start, after = m.span()
        name, content = (m[2] or "").lower(), m[3]
        kind = "close" if m[1] else "open"
        if content is None:
            end = page.find("-->", after)
            kind, after = "hidden", len(page) if end < 0 else end + 3
        elif kind == "open" and name in HIDDEN and not content.endswith("/"):
            if name not in closers:
                closers[name] = _Closer(page, name)
            kind, after = "hidden", closers[name].after(after)
        if at < start:
            yield "text", "", page[at:start]
        yield kind, name, content or ""
        at = after
    comment = page.find("<!--", at)
    end = len(page) if comment < 0 else comment
    if at < end:
        yield "text", "", page[at:end]
    if comment >= 0:
        yield "hidden", "", ""


def attributes(content: str) -> Iterator[tuple[str, str]]:
    """(name, value) of a tag's attributes, names in lower case."""
    at = 0
    while at < len(content) and (m := _ATTRIBUTE.match(content, at)).end() > at:
        at = m.end()
        if m[1]:
            yield m[1].lower(), unescaped(next((x for x in m.groups()[1:] if x is not None), ""))


def unescaped(text: str) -> str:
    """Text with its character references resolved; numbers beyond Unicode are U+FFFD."""
    return html.unescape(_LONG_NUMBER.sub("�", text))


def read(page: str) -> tuple[str, str, str, list[str]]:
    """(visible text with a line a block, title, language, links in order)."""
    shown: list[str] = []
    title: list[str] | None = None
    in_title, lang, links = False, "", []
    for kind, name, content in pieces(page):
        if kind == "text":
            shown.append(content)
            if in_title and title is not None:
                title.append(content)
            continue
        shown.append("\n" if name in BLOCKS else " " if kind == "hidden" else "")
        if name == "title":
            in_title = kind == "open" and title is None
            title = [] if in_title else title
        elif kind == "open" and name == "html" and not lang:
            lang = next((v for k, v in attributes(content) if k == "lang"), "")
        elif kind == "open" and name == "a":
            links += [v for k, v in attributes(content) if k == "href"][:1]
    lines = (_BLANK.sub(" ", x).strip() for x in unescaped("".join(shown)).split("\n"))
    return "\n".join(x for x in lines if x), one_line(unescaped("".join(title or ()))), one_line(lang), [x for x in map(one_line, links) if x]


def one_line(text: str) -> str:
    """Text without line breaks and repeated blanks."""
    return " ".join(text.split())
