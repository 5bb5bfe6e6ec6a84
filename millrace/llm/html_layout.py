"""HTML to visible text, laid out as a reader sees it: blocks, lists and aligned table cells."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import map_documents

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?|[\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no markup, up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas svg math datalist map".split())
#: Blocks with a blank line before and after, and blocks that begin a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre xmp blockquote figure fieldset hr menu".split())
BLOCKS = SPACED | frozenset("html body div article section nav header footer main aside address li dt dd form details summary dialog center "
                            "figcaption legend hgroup search optgroup caption thead tbody tfoot tr td th".split())
#: Start tag: open elements that it ends, and the elements that this does not reach beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}), "a": ({"a"}, {"td", "th", "table", "object"}), "button": ({"button"}, {"td", "th", "table"}),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What ends an open paragraph.
ENDS_PARAGRAPH = (BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "optgroup", "legend"}) | {"hr"}
HEAD_ONLY = frozenset("html head meta link title base script style noscript template".split())
#: An end tag reaches no further than the cell it stands in.
WALLS = frozenset(("td", "th", "caption", "table"))


class Box:
    """Lines of one block; ``need`` is the spacing due before the next text (0 none, 1 new line, 2 blank line)."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.need, self.space = "", 0, False

    def text(self, text: str, keep_spaces: bool) -> None:
        if keep_spaces:
            for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
                if k:
                    self.end_line(True)
                if part:
                    self.begin()
                    self.line += part
            return
        text = SPACES.sub(" ", text)
        if text == " " or not text:
            self.space = self.space or (text == " " and bool(self.line))
            return
        self.begin()
        if self.line and (self.space or text[0] == " ") and self.line[-1] != "\n":
            self.line += " "
        self.space = text[-1] == " "
        self.line += text.strip(" ")

    def begin(self) -> None:
        if self.need and not self.line and self.lines and self.need == 2 and self.lines[-1] != "":
            self.lines.append("")
        self.need = 0

    def end_line(self, forced: bool = False) -> None:
        if self.line or forced:
            self.lines.append(self.line.rstrip(" "))
        self.line, self.space = "", False

    def gap(self, need: int) -> None:
        self.end_line()
        self.need = max(self.need, need)

    def add(self, lines: list[str], need: int) -> None:
        """A finished block of lines."""
        self.gap(need)
        if lines:
            self.begin()
            self.lines += lines
            self.need = need

    def close(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        first = next((k for k, line in enumerate(self.lines) if line), len(self.lines))
        return self.lines[first:]


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, bool]]] = []
        self.caption: list[str] = []

    def lines(self) -> list[str]:
        """Cells of a column begin at the same place; a cell over several columns takes their width."""
        grid = [[(cell, span) for cell, span, _ in row] for row in self.rows if row]
        widths: list[int] = []
        for row in grid:
            at = 0
            for cell, span in row:
                widths += [0] * (at + span - len(widths))
                if span == 1:
                    widths[at] = max(widths[at], *map(len, cell), 0) if cell else widths[at]
                at += span
        for row in grid:
            at = 0
            for cell, span in row:
                wide = max(map(len, cell), default=0) - sum(widths[at:at + span]) - 2 * (span - 1)
                if span > 1 and wide > 0:
                    widths[at + span - 1] += wide
                at += span
        out = list(self.caption)
        for row in grid:
            for k in range(max(len(cell) for cell, _ in row)):
                at, line = 0, ""
                for cell, span in row:
                    width = sum(widths[at:at + span]) + 2 * (span - 1)
                    line += (cell[k] if k < len(cell) else "").ljust(width) + "  "
                    at += span
                out.append(line.rstrip())
        return out


class Page:
    """Tree builder and renderer in one walk: open elements are a stack, and each list item, cell and quotation has a box.

    Nothing recurses, so depth is bounded by memory only.
    """

    def __init__(self):
        self.open: list[tuple[str, bool, object]] = []  # element, whether it hides, what it opened
        self.boxes, self.tables, self.lists = [Box()], [], []
        self.hidden = self.kept_spaces = 0
        self.counts: dict[str, int] = {}

    def render(self, source: str) -> str:
        at, end = 0, len(source)
        while at < end:
            found = TOKEN.search(source, at)
            stop = found.start() if found else end
            if stop > at:
                self.text(source[at:stop])
            if not found:
                break
            at = max(found.end(), stop + 1)
            name = found.group(2)
            if name is None:
                continue
            name = name.lower()
            if found.group(1):
                self.end(name)
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                if name in ("textarea", "xmp") and not self.hidden:
                    self.start(name, found.group(3))
                    self.text(source[at:close.start()])
                    self.end(name)
                at = close.end()
                continue
            self.start(name, found.group(3))
        while self.open:
            self.pop()
        return "\n".join(self.boxes[0].close())

    def text(self, raw: str) -> None:
        if not self.hidden:
            if self.open and self.open[-1][0] in ("table", "tr", "tbody", "thead", "tfoot", "ul", "ol") and not raw.strip(" \t\n\r\f"):
                return
            self.boxes[-1].text(html.unescape(raw).replace("\0", "") if "&" in raw or "\0" in raw else raw, self.kept_spaces > 0)
        elif self.open and self.open[-1][0] == "head" and raw.strip(" \t\n\r\f"):
            self.pop()
            self.text(raw)

    def start(self, name: str, rest: str) -> None:
        # A paragraph, item, row or cell that is still open ends where its successor begins.
        if name in ENDS_PARAGRAPH and self.counts.get("p"):
            self.close_up({"p"}, WALLS | {"button"})
        if name in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop()
        if name in CLOSES:
            closes, walls = CLOSES[name]
            if any(self.counts.get(c) for c in closes):
                self.close_up(closes, walls)
        if self.open and self.open[-1][0] == "head" and name not in HEAD_ONLY:
            self.pop()
        if name in ("td", "th") and self.tables and not self.within("tr"):
            self.start("tr", "")
        attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {}
        box = self.boxes[-1]
        if name in VOID:
            if not self.hidden and not self.unseen(name, attributes):
                if name == "br":
                    box.begin()
                    box.end_line(True)
                elif name == "hr":
                    box.gap(2)
            return
        hides = self.unseen(name, attributes)
        opened: object = None
        if not self.hidden and not hides:
            if name in BLOCKS and name not in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "li", "blockquote", "dd", "table"):
                box.gap(self.space(name))
            if name in ("pre", "xmp", "textarea"):
                self.kept_spaces += 1
            if name in ("ul", "ol", "menu"):
                start = attributes.get("start", "1")
                self.lists.append([name == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                opened = "list"
            elif name == "table":
                self.tables.append(Table())
                opened = "table"
            elif name == "tr" and self.tables:
                self.tables[-1].rows.append([])
            elif name in ("li", "blockquote", "dd") or name in ("td", "th", "caption") and self.tables:
                span = attributes.get("colspan", "1")
                value = attributes.get("value", "")
                opened = (name, min(int(span), 1000) if re.fullmatch(r"[1-9]\d{0,3}", span) else 1, int(value) if re.fullmatch(r"-?\d{1,9}", value) else None)
                self.boxes.append(Box())
        self.hidden += hides
        self.open.append((name, hides, opened))
        self.counts[name] = self.counts.get(name, 0) + 1

    def space(self, name: str) -> int:
        return 2 if name in SPACED and not (name in ("ul", "ol", "menu") and self.lists) else 1

    def unseen(self, name: str, attributes: dict) -> bool:
        return (name in UNSEEN or "hidden" in attributes or bool(HIDDEN_STYLE.search(attributes.get("style", ""))) or name == "input"
                or name == "dialog" and "open" not in attributes)

    def within(self, name: str) -> bool:
        """Whether ``name`` is open inside the innermost table."""
        for own, _, _ in reversed(self.open):
            if own in (name, "table"):
                return own == name
        return False

    def close_up(self, names, walls) -> None:
        """End the outermost open element of ``names`` that no wall hides, with what is in it."""
        for k in range(len(self.open) - 1, -1, -1):
            own = self.open[k][0]
            if own in names and not (k and self.open[k - 1][0] in names):
                while len(self.open) > k:
                    self.pop()
                return
            if own in walls:
                return

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        if not self.counts.get(name):
            if name == "p":
                self.boxes[-1].gap(2)
            return
        for k in range(len(self.open) - 1, -1, -1):
            own = self.open[k][0]
            if own == name:
                while len(self.open) > k:
                    self.pop()
                return
            if own in WALLS and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
                return

    def pop(self) -> None:
        name, hides, opened = self.open.pop()
        self.counts[name] -= 1
        self.hidden -= hides
        if hides or self.hidden:
            return
        if opened == "list":
            self.lists.pop()
        elif opened == "table":
            lines = self.tables.pop().lines()
            self.boxes[-1].add(lines, 2)
            return
        elif isinstance(opened, tuple):
            kind, span, value = opened
            lines = self.boxes.pop().close()
            if kind in ("td", "th"):
                if self.tables and self.tables[-1].rows:
                    self.tables[-1].rows[-1].append((lines, span, kind == "th"))
            elif kind == "caption":
                self.tables[-1].caption += lines
            elif kind == "li":
                mark = "- "
                if self.lists and self.lists[-1][0]:
                    number = self.lists[-1][1] if value is None else value
                    self.lists[-1][1] = number + 1
                    mark = f"{number}. "
                self.boxes[-1].add([(mark if not k else " " * len(mark) if line else "") + line for k, line in enumerate(lines)], 1)
            else:
                pad = "> " if kind == "blockquote" else "  "
                self.boxes[-1].add([(pad + line).rstrip() for line in lines], 2 if kind == "blockquote" else 1)
            return
        if name in ("pre", "xmp", "textarea"):
            self.kept_spaces -= 1
        if name in BLOCKS and name not in ("tr", "tbody", "thead", "tfoot", "html"):
            self.boxes[-1].gap(self.space(name))


def visible_text(source: bytes) -> str:
    return Page().render(source.decode("utf-8", "replace"))


def extract(pages: DataFrame, carry=("page_id",), markup: str = "html") -> DataFrame:
    """``doc`` (the carried columns) and ``text``: all that a reader sees, in order, with its layout.

    Blocks begin lines, paragraphs, headings, lists and tables have blank lines around them, list items have marks and
    are indented by depth, cells of a column are aligned, ``pre`` keeps its spaces. Scripts, styles, the head, hidden elements
    (attribute or inline style) and closed dialogs are left out. Null and empty pages give empty text; broken markup is mended
    as browsers do for paragraphs, items, rows and cells; repeated rows are laid out each. Nothing is shuffled.
    """
    def make():
        def work(sources):
            return [pa.array([visible_text(s) for s in sources], pa.string())]
        return work

    return map_documents(pages, markup, carry, make, "text string")
