"""One norm's XML to block lines, table cells and fields: a pushdown fold over parser events.

Each open element that shapes the text has a frame on a stack; a frame takes the events inside it
and leaves finished lines behind. Lists keep their printed markers: an item takes its line when it
opens, so nested items follow it, and is filled when it closes. Lines are raw: sentences, escapes
of lines and indents are column expressions in ``operators.laws``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.parsers import expat

# Markdown characters escaped inside a line, and the wide spaces.
ESCAPED = {ord(c): "\\" + c for c in "\\`*_[]<"}
WIDE = {0x00A0: " ", 0x202F: " ", 0x2009: " "}
# What stands before and after an inline element's text.
AROUND = {"SUP": ("<sup>", "</sup>"), "SUB": ("<sub>", "</sub>"), "DT": (" ", " "), "DD": ("", " "), "LA": ("", " ")}
# Elements that stand for themselves, and layout of the print edition.
INSTEAD = {"BR": " ", "QuoteL": "„", "QuoteR": "“"}
LAYOUT = {"Split", "Accolade", "ABWFORMAT", "FnArea", "AttArea", "AttR"}
NO_BLOCK = {"TOC", "BR", "FnArea", "AttArea", "Footnotes"}
HEADING = {"Ident", "Title", "Subtitle"}
HTML = {ord(c): e for c, e in zip("&<>\"'", ("&amp;", "&lt;", "&gt;", "&quot;", "&#039;"))}
FIELDS = {"enbez", "titel", "jurabk", "amtabk", "langue", "kurzue", "ausfertigung-datum"}
UNIT, NOTE, PLACE = "gliederungseinheit", "standangabe", "fundstelle"


def collapsed(text: str) -> str:
    return re.sub(r"[ \t\r\n]+", " ", text.translate(WIDE)).strip(" \t\n\r\0\x0b")


def label_of(source_id: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "-", source_id).lower().strip("-")


def link(source: str, base: str) -> str:
    return source if re.match("https?://", source, re.I) else f"{base.rstrip('/')}/{source.lstrip('/')}"


class Inline:
    """Gathers the text of a run of inline nodes."""

    def __init__(self, base: str, escape: bool = True) -> None:
        self.base, self.escape, self.parts, self.closing, self.hidden = base, escape, [], [], 0

    def text(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data.translate(ESCAPED) if self.escape else data)

    def _alone(self, tag: str, a: dict[str, str]) -> str | None:
        """What an element without inner text becomes; None for one with inner text."""
        if tag in INSTEAD or tag in LAYOUT:
            return INSTEAD.get(tag, "")
        named = lambda k, other: (a[k].translate(ESCAPED) if self.escape else a[k]) if a.get(k) else other
        source = a.get("SRC", "")
        if tag == "FnR":
            return f"[^{label_of(a['ID'])}]" if a.get("ID") else ""
        if tag == "IMG":
            return f"![{named('alt', 'Abbildung')}]({link(source, self.base)})" if source else ""
        if tag == "FILE":
            return f"[{named('title', source)}]({link(source, self.base)})" if source else ""
        return None

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if self.hidden:
            self.hidden += 1
        elif (alone := self._alone(tag, attributes)) is not None:
            self.parts.append(alone)
            self.hidden = 1
        else:
            before, after = AROUND.get(tag, ("", ""))
            self.parts.append(before)
            self.closing.append(after)

    def end(self) -> None:
        if self.hidden:
            self.hidden -= 1
        else:
            self.parts.append(self.closing.pop())

    def taken(self) -> str:
        text = collapsed("".join(self.parts))
        self.parts = []
        return text


class Frame:
    """An open element. ``start`` gives the frame of a child; ``close`` runs at its end."""

    def __init__(self, norm: Norm) -> None:
        self.norm = norm

    def start(self, tag: str, attributes: dict[str, str]) -> Frame:
        return Frame(self.norm)

    def text(self, data: str) -> None:
        pass

    def close(self) -> None:
        pass


class Run(Frame):
    """Inline content of one element, handed to ``then`` when it closes."""

    def __init__(self, norm: Norm, then: Callable[[str], None], escape: bool = True) -> None:
        super().__init__(norm)
        self.inline, self.then = Inline(norm.base, escape), then

    def start(self, tag, attributes):
        self.inline.start(tag, attributes)
        return Inner(self.norm, self.inline)

    def text(self, data):
        self.inline.text(data)

    def close(self):
        self.then(self.inline.taken())


class Inner(Frame):
    """An element inside a run. ``apart`` sets it off from what follows by a space."""

    def __init__(self, norm: Norm, inline: Inline, apart: bool = False) -> None:
        super().__init__(norm)
        self.inline, self.apart = inline, apart

    def start(self, tag, attributes):
        self.inline.start(tag, attributes)
        return Inner(self.norm, self.inline)

    def text(self, data):
        self.inline.text(data)

    def close(self):
        self.inline.end()
        if self.apart:
            self.inline.parts.append(" ")


class Raw(Frame):
    """All text inside an element, as it stands."""

    def __init__(self, norm: Norm, then: Callable[[str], None], parts: list[str] | None = None) -> None:
        super().__init__(norm)
        self.parts, self.then = [] if parts is None else parts, then

    def start(self, tag, attributes):
        return Raw(self.norm, lambda _: None, self.parts)

    def text(self, data):
        self.parts.append(data)

    def close(self):
        self.then("".join(self.parts))


class Blocks(Frame):
    """A container of blocks."""

    def start(self, tag, attributes):
        if tag == "P":
            return Paragraph(self.norm)
        if tag in ("Revision", "noindex"):
            return Blocks(self.norm)
        if tag in NO_BLOCK:
            return Frame(self.norm)
        if tag in HEADING:
            return Run(self.norm, lambda t: self.norm.block("verbatim", f"**{t}**" if t else ""))
        return self.norm.own_block(tag) or Run(self.norm, lambda t: self.norm.block("paragraph", t))

    def text(self, data):
        inline = Inline(self.norm.base)
        inline.text(data)
        self.norm.block("paragraph", inline.taken())


class Paragraph(Frame):
    """Prose, cut where a list, table or preformatted text stands inside."""

    def __init__(self, norm):
        super().__init__(norm)
        self.inline = Inline(norm.base)

    def start(self, tag, attributes):
        if tag in ("DL", "table", "pre"):
            self.close()
            return self.norm.own_block(tag)
        self.inline.start(tag, attributes)
        return Inner(self.norm, self.inline, apart=True)

    def text(self, data):
        self.inline.text(data)
        self.inline.parts.append(" ")

    def close(self):
        self.norm.block("paragraph", self.inline.taken())


class Listing(Frame):
    """A list at some depth; its items share one block."""

    def __init__(self, norm, depth):
        super().__init__(norm)
        self.depth, self.marker = depth, None

    def _marked(self, text: str) -> None:
        self.marker = text

    def start(self, tag, attributes):
        if tag == "DT":
            return Run(self.norm, self._marked)
        if tag != "DD":
            return Frame(self.norm)
        marker, self.marker = self.marker, None
        return Item(self.norm, self.depth, marker)


class Item(Frame):
    def __init__(self, norm, depth, marker):
        super().__init__(norm)
        self.depth, self.inline, self.line = depth, Inline(norm.base), norm.reserved(depth, marker)

    def start(self, tag, attributes):
        return self.part() if tag in ("LA", "Revision") else self.child(tag, attributes)

    def part(self) -> Frame:
        own = Frame(self.norm)
        own.start, own.text = self.child, self.text
        return own

    def child(self, tag, attributes):
        if tag == "DL":
            return Listing(self.norm, self.depth + 1)
        self.inline.start(tag, attributes)
        return Inner(self.norm, self.inline, apart=True)

    def text(self, data):
        self.inline.text(data)
        self.inline.parts.append(" ")

    def close(self):
        self.norm.filled(self.line, self.inline.taken())


class Table(Frame):
    """A table of column-named and merged cells."""

    def __init__(self, norm):
        super().__init__(norm)
        self.title, self.groups, self.columns = None, [], {}

    def _titled(self, text: str) -> None:
        self.title = text

    def start(self, tag, attributes):
        if tag == "Title" and self.title is None:
            return Run(self.norm, self._titled)
        return TablePart(self, None).start(tag, attributes)

    def close(self):
        self.norm.table(self)


class TablePart(Frame):
    """Anything below a table: groups, sections, rows; entries are runs of text."""

    def __init__(self, table: Table, section: str | None):
        super().__init__(table.norm)
        self.table, self.section = table, section

    def start(self, tag, attributes):
        groups, section = self.table.groups, self.section
        if tag == "tgroup":
            groups.append([])
            self.table.columns = {}
        elif tag == "colspec" and attributes.get("colname"):
            self.table.columns.setdefault(attributes["colname"], len(self.table.columns))
        elif tag in ("thead", "tbody", "tfoot") and groups:
            section = tag
        elif tag == "row" and section:
            groups[-1].append((section, []))
        elif tag == "entry" and section and groups[-1]:
            row, columns = groups[-1][-1][1], self.table.columns
            return Run(self.norm, lambda t: row.append((attributes, columns, t)))
        return TablePart(self.table, section)


def span_width(a: dict[str, str]) -> int:
    first, last = a.get("namest", ""), a.get("nameend", "")
    number = lambda name: int(re.sub(r"\D+", "", name) or 0)
    return max(number(last) - number(first) + 1, 1) if first and last and first != last else 1


def span_height(a: dict[str, str]) -> int:
    more = a.get("morerows", "")
    return int(more) + 1 if more.isascii() and more.isdigit() else 1


def placed(rows: list[list[tuple[int, int, int | None]]]) -> list[list[int]]:
    """The first column of each cell (width, height, named column or None).

    One fold over the rows: ``held`` tells for each column how many more rows a cell from
    above holds it. A cell takes its named column, or the first free run of its width.
    """
    held: dict[int, int] = {}
    out = []
    for row in rows:
        taken = {c for c, n in held.items() if n > 0}
        held = {c: n - 1 for c, n in held.items() if n > 1}
        at, places = 0, []
        for width, height, named in row:
            at = named if named is not None and not taken & set(range(named, named + width)) else at
            while taken & set(range(at, at + width)):
                at += 1
            places.append(at)
            taken |= set(range(at, at + width))
            if height > 1:
                held |= dict.fromkeys(range(at, at + width), height - 1)
            at += width
        out.append(places)
    return out


def rendered_group(rows: list[tuple[str, list[tuple[dict, dict, str]]]]) -> str:
    """Pipe lines where no cell is merged and all rows are equally wide, HTML otherwise."""
    order = [s for name in ("thead", "tbody", "tfoot") for s in rows if s[0] == name]
    if not order:
        return ""
    entries = [e for _, row in rows for e in row]
    merged = any(a.get("morerows") or a.get("spanname") or (a.get("namest") and a["namest"] != a.get("nameend", "")) for a, _, _ in entries)
    width = len(order[0][1])
    if merged or any(len(row) != width for _, row in order):
        return _html(order)
    if not width:
        return ""
    lines = [[t.replace("|", "\\|") for _, _, t in row] for _, row in order]
    if order[0][0] != "thead":
        lines.insert(0, [""] * width)
    written = [f"| {' | '.join(line)} |" for line in lines]
    return "\n".join([written[0], "|" + " --- |" * width, *written[1:]])


def _html(order: list[tuple[str, list]]) -> str:
    out, before = "<table>\n", None
    for section, row in order:
        if section != before:
            out += (f"</{_part(before)}>\n" if before else "") + f"<{_part(section)}>\n"
            before = section
        cell = "th" if section == "thead" else "td"
        out += "<tr>\n"
        for a, _, text in row:
            spans = "".join(f' {n}="{k}"' for n, k in (("rowspan", span_height(a)), ("colspan", span_width(a))) if k > 1)
            plain = re.sub(r"\\([\\`*_\[\]<])", r"\1", text).translate(HTML)
            out += f"<{cell}{spans}>{plain}</{cell}>\n"
        out += "</tr>\n"
    return out + f"</{_part(before)}>\n</table>"


def _part(section: str) -> str:
    return "tbody" if section == "tfoot" else section


class Fields(Frame):
    """Metadata: of each field the first counts; units, notes and places of publication."""

    def __init__(self, norm, into: dict, at: str = ""):
        super().__init__(norm)
        self.into, self.at = into, at

    def start(self, tag, attributes):
        norm = self.norm
        if tag == UNIT:
            return Fields(norm, norm.units_of(), tag)
        if tag in (NOTE, PLACE):
            own = {"typ": attributes.get("typ", "")}
            (norm.notes if tag == NOTE else norm.places).append(own)
            return Fields(norm, own, tag)
        if self.at or tag in FIELDS:
            into = self.into
            return Run(norm, lambda t: into.setdefault(tag, t), escape=False)
        return Fields(norm, {}, "other")


class Text(Frame):
    """The text or the footnotes of a norm: blocks are in its first content."""

    def __init__(self, norm):
        super().__init__(norm)
        self.seen = False

    def start(self, tag, attributes):
        first, self.seen = tag == "Content" and not self.seen, self.seen or tag == "Content"
        return Blocks(self.norm) if first else Frame(self.norm)


class TextData(Frame):
    """Only the first element of a name counts; the text goes before the footnotes."""

    def __init__(self, norm):
        super().__init__(norm)
        self.seen: set[str] = set()

    def start(self, tag, attributes):
        if tag not in ("text", "fussnoten") or tag in self.seen:
            return Frame(self.norm)
        self.seen.add(tag)
        self.norm.lines = self.norm.parts[tag]
        return Text(self.norm)


class Root(Frame):
    def __init__(self, norm):
        super().__init__(norm)
        self.seen: set[str] = set()

    def start(self, tag, attributes):
        first, _ = tag not in self.seen, self.seen.add(tag)
        if first and tag == "metadaten":
            return Fields(self.norm, self.norm.fields)
        return TextData(self.norm) if first and tag == "textdaten" else Frame(self.norm)


class Norm:
    """The fold. After :meth:`read`: fields, unit, notes, places, lines and cells."""

    def __init__(self, base: str) -> None:
        self.base = base
        self.fields: dict[str, str] = {}
        self.unit: dict[str, str] | None = None
        self.notes: list[dict[str, str]] = []
        self.places: list[dict[str, str]] = []
        self.parts: dict[str, list[list]] = {"text": [], "fussnoten": []}
        self.lines = self.parts["text"]
        self.footnotes: list[tuple[str, str]] = []
        self.cells: list[tuple] = []
        self.blocks, self.tables = 0, 0
        self.document_id: str | None = None

    def units_of(self) -> dict[str, str]:
        own: dict[str, str] = {}
        if self.unit is None:
            self.unit = own
        return own

    def block(self, kind: str, text: str) -> None:
        if text.strip():
            self.blocks += 1
            self.lines.append([self.blocks, kind, 0, None, text])

    def own_block(self, tag: str) -> Frame | None:
        if tag == "DL":
            self.blocks += 1
            return Listing(self, 0)
        if tag == "table":
            return Table(self)
        if tag == "pre":
            return Raw(self, lambda t: self.block("verbatim", "```text\n" + t.replace(" ", " ").replace("\r\n", "\n").rstrip(" \t\n\r\0\x0b") + "\n```"))
        return None

    def reserved(self, depth: int, marker: str | None) -> list:
        self.lines.append([self.blocks, "item", depth, marker, ""])
        return self.lines[-1]

    def filled(self, line: list, text: str) -> None:
        line[4] = text

    def table(self, table: Table) -> None:
        for rows in table.groups:
            spans = [[(span_width(a), span_height(a), columns.get(a.get("namest") or a.get("colname", ""))) for a, columns, _ in row] for _, row in rows]
            for r, ((section, row), at) in enumerate(zip(rows, placed(spans))):
                self.cells += [(self.tables, section, r, c, span_width(a), span_height(a), t) for (a, _, t), c in zip(row, at)]
            self.tables += 1
        written = "\n\n".join(g for g in map(rendered_group, table.groups) if g)
        self.block("verbatim", f"**{table.title}**\n\n{written}" if table.title and written else written)

    def read(self, xml: str) -> Norm:
        stack: list[Frame] = []
        notes: list[tuple[str, Inline]] = []  # footnotes that are open, wherever they stand
        parser = expat.ParserCreate()
        parser.buffer_text = True

        def start(tag: str, attributes: dict[str, str]) -> None:
            for _, inline in notes:
                inline.start(tag, attributes)
            if not stack:
                self.document_id = attributes.get("doknr") or None
                stack.append(Root(self))
                return
            stack.append(stack[-1].start(tag, attributes))
            if tag == "Footnote":
                inline = Inline(self.base)
                inline.closing.append("")
                notes.append((attributes.get("ID", ""), inline))

        def end(tag: str) -> None:
            stack.pop().close()
            for _, inline in notes:
                inline.end()
            if tag == "Footnote":
                source_id, inline = notes.pop()
                self.footnotes.append((source_id, inline.taken()))

        def text(data: str) -> None:
            if stack:
                stack[-1].text(data)
            for _, inline in notes:
                inline.text(data)

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
        parser.CommentHandler = lambda _: None  # text around a comment is two nodes
        parser.Parse(xml, True)
        self.lines = [*self.parts["text"], *self.parts["fussnoten"]]
        labelled: list[str] = []
        for source_id, note in self.footnotes:
            if note:
                labelled.append(f"[^{label_of(source_id) if source_id else f'fn-{len(labelled) + 1}'}]: {note}")
        for note in ["## Fußnoten", *labelled] if labelled else []:
            self.block("verbatim", note)
        return self
