"""HTML to text."""

from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import SPACE
from spindrift.session import over_batches

#: Fixed values.
DROPPED = {"script", "style", "nav", "footer", "header", "iframe", "noscript", "svg", "img"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "small", "strong", "tt", "u"}


class _Text(HTMLParser):
    """Text outside DROPPED elements. One that is never closed ends with the element that it is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.many, self.skip, self.in_head, self.out = [], Counter(), 0, False, []

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.in_head = True
        if tag == "body":
            self.in_head = False
        if tag not in _VOID:
            self.open.append(tag)
            self.many[tag] += 1
            self.skip += tag in DROPPED

    def handle_endtag(self, tag):
        if tag == "head":
            self.in_head = False
        if not self.many[tag] or tag in ("html", "body"):  # what follows the body still belongs to what is open
            return
        # a formatting tag ends no more than itself
        if tag in _FORMATTING:
            at = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i] == tag)
            del self.open[at]
            self.many[tag] -= 1
            return
        while True:
            last = self.open.pop()
            self.many[last] -= 1
            self.skip -= last in DROPPED
            if last == tag:
                return

    def handle_data(self, data):
        if not self.skip and not self.in_head:
            self.out.append(data)


def body_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    return "".join(p.out)


def _body_text(c: Column) -> Column:
    # the UDF is made where it is used: workers import this module as well
    return over_batches(body_text, "string")(F.coalesce(c, F.lit("")))


def clean(c: Column) -> Column:
    """White space in a line becomes one space; lines are joined by spaces, paragraphs by blank lines."""
    lines = F.split(F.regexp_replace(c, "\r\n", "\n"), "\n", -1)
    lines = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, f"{SPACE}+", " "), "^ | $", ""))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "^\n+|\n+$", ""), "\n{2,}", "\u0001")
    return F.regexp_replace(F.regexp_replace(joined, "\n", " "), "\u0001", "\n\n")


def html_text(c: Column) -> Column:
    return clean(_body_text(c))
