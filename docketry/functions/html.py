"""Reading web pages: one scan over the markup that yields tags and text, and what is made of them."""

from __future__ import annotations

import re
from html import unescape

LINE_TAGS = frozenset("p div br li tr section article header footer h1 h2 h3 h4 h5 h6".split())
UNSEEN_TAGS = frozenset("script style noscript template svg".split())
HEADING = re.compile(r"h[1-6]$")
RAW_TAGS = frozenset(("script", "style"))  # their content holds no markup
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*?)(/?)>""")
_HREF = re.compile(r"""(?:^|[\s/"'])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LINE_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def scan(html: str):
    """(kind, name, rest): kind is "text", "open", "close" or "both" (an empty element); text stands in ``rest``."""
    at, size = 0, len(html)
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            yield "text", "", html[at:mark]
            at = mark
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = size if end < 0 else end + 3
        elif html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = size if end < 0 else end + 1
        elif (tag := _TAG.match(html, at)) is not None:
            name, at = tag[1].lower(), tag.end()
            kind = "close" if html[tag.start() + 1] == "/" else "both" if tag[3] else "open"
            yield kind, name, tag[2]
            if kind == "open" and name in RAW_TAGS:
                close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = size if close is None else close.start()
        else:
            yield "text", "", "<"
            at += 1


def _one_line(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def tidy(text: str) -> str:
    """Lines trimmed, runs of blanks made one, runs of empty lines made one."""
    lines = (re.sub(r"[ \t\f\v]+", " ", line).strip() for line in _LINE_BREAK.split(text))
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(lines)).strip()


def parse_html(html: str | None) -> tuple[str, str | None, list[str], list[str]]:
    """(text, title, headings, hrefs) of a page.

    Text inside unseen elements counts nowhere; titles are joined and stand outside the text; an
    element of ``LINE_TAGS`` begins and ends a line.
    """
    unseen, in_title, in_heading = 0, False, False
    title, titles, heading = None, [], []
    text, headings, hrefs = [], [], []
    for kind, name, rest in scan(html or ""):
        if kind == "text":
            if unseen:
                continue
            words = unescape(rest) if "&" in rest else rest
            if in_title:
                titles.append(words)
            else:
                text.append(words)
                if in_heading:
                    heading.append(words)
            continue
        if name in LINE_TAGS:
            text.append("\n" if kind != "both" else "\n\n")
        opens, closes = kind in ("open", "both"), kind in ("close", "both")
        if name == "a" and opens and "href" in rest.lower():
            hrefs += [link for a, b, c in _HREF.findall(rest)[:1] if (link := unescape(a or b or c).strip())]
        elif name in UNSEEN_TAGS:
            unseen = max(0, unseen + opens - closes)
        elif name == "title":
            in_title = opens and not closes
            if closes:
                title = _one_line(titles) or None
        elif HEADING.match(name):
            if opens:
                heading = []
            in_heading = opens and not closes
            if closes and (words := _one_line(heading)):
                headings.append(words)
    return tidy("".join(text)), title, headings, hrefs
