"""The part of CommonMark that chunking needs: which text a document's blocks hold.

``Blocks`` walks the lines of a text and tells a sink what opens, closes and is said. Headings, fenced
and indented code, lists, quotes, pipe tables, HTML blocks and link definitions are known, and inline
code, links, images, emphasis, strike-through, escapes, entities, autolinks and inline HTML.

Known deviations from a full parser: a lazy continuation line inside nested lists ends at the first line
that could open a block; emphasis is matched run by run without the rule of three; link titles and
destinations are checked only for their brackets and quotes; tabs count as four spaces at line starts.
"""

from __future__ import annotations

import html
import re

_FENCE = re.compile(r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+|$)")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_QUOTE = re.compile(r"^ {0,3}> ?")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<][^\s]*)(?:[ \t]+\n?[ \t]*|\n[ \t]*)?(\"[^\"]*\"|'[^']*'|\([^()]*\))?[ \t]*(?:\n|\Z)")
_HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem "
    "nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_HTML_OPEN = [
    (re.compile(r"^ {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"^ {0,3}<!--"), re.compile("-->")),
    (re.compile(r"^ {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r"^ {0,3}<![A-Za-z]"), re.compile(">")),
    (re.compile(r"^ {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"^ {{0,3}}</?(?:{'|'.join(_HTML_NAMES.split())})(?:\s|/?>|$)", re.I), None),
]
_TAG = r"<(?:/[A-Za-z][A-Za-z0-9-]*\s*|[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?)>"
_HTML_ALONE = re.compile(rf"^ {{0,3}}{_TAG}[ \t]*$")
_INLINE_HTML = re.compile(rf"{_TAG}|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9.-]+)>")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_SPECIAL = re.compile(r"[\\`*_~\[\]<&]")
_PLAIN = re.compile(r"(?:[^\\`*_~\[\]<&!]+|!(?!\[))+")
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|[^\s()<]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_BREAK = re.compile(r"(?<!\\)\\\n")
#: Lines that may end a paragraph; all others go on with it unless a table begins.
_MAY_END = re.compile(r"[ \t]*(?:$|[`~#>*\-_+<=1])")
_TICKS = re.compile("`+")
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_TASK = re.compile(r"^\[[ xX]\][ \t]+")


def _name(label: str) -> str:
    return " ".join(label.split()).casefold()


class Blocks:
    """Tells ``sink`` the blocks of a text: say, line_end, flush, code, table_start, table_head, cell, row, table_end."""

    def __init__(self, sink, text: str, heading_sep: str = ""):
        self.sink, self.heading_sep = sink, heading_sep
        self.names: set[str] = set()
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if "]:" in text:
            for m in re.finditer(r"(?m)^ {0,3}\[((?:[^\[\]\\\n]|\\.)+)\]:", text):
                self.names.add(_name(m[1]))
        self.blocks(lines, False)

    def blocks(self, lines: list[str], tight: bool) -> None:
        i, n = 0, len(lines)
        while i < n:
            line = lines[i]
            if not line.strip(" \t"):
                i += 1
                continue
            first = line.lstrip(" ")[:1]
            if line.startswith(("    ", "\t")):
                i = self.indented(lines, i)
            elif first in "`~" and (m := _FENCE.match(line)):
                i = self.fenced(lines, i, m)
            elif first == "#" and (m := _ATX.match(line)):
                self.inline(re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", line[m.end() :]).strip())
                self.sink.say(self.heading_sep)
                i += 1
            elif first in "*-_" and _RULE.match(line):
                i += 1
            elif first == ">" and _QUOTE.match(line):
                i = self.quote(lines, i)
            elif (first in "-+*" or first.isdigit()) and (m := _ITEM.match(line)):
                i = self.list(lines, i, m)
            elif first == "<" and (end := self.html(lines, i)):
                i = end
            else:
                i = self.paragraph(lines, i, tight)

    def fenced(self, lines: list[str], i: int, m: re.Match) -> int:
        mark, indent = m[1], len(m[0]) - len(m[1])
        close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
        body = []
        i += 1
        while i < len(lines) and not close.match(lines[i]):
            line = lines[i]
            body.append(line[min(indent, len(line) - len(line.lstrip(" "))) :] + "\n")
            i += 1
        if i >= len(lines) and body and body[-1] == "\n":
            body.pop()  # the end of the text is no line of its own
        self.sink.code("".join(body))
        return i + 1

    def indented(self, lines: list[str], i: int) -> int:
        body, blanks = [], []
        while i < len(lines):
            line = lines[i]
            if not line.strip(" \t"):
                blanks.append(line[4:] + "\n")
            elif line.startswith("    ") or line.startswith("\t"):
                body += blanks
                blanks = []
                body.append((line[1:] if line[0] == "\t" else line[4:]) + "\n")
            else:
                break
            i += 1
        self.sink.code("".join(body))
        return i

    def interrupts(self, line: str) -> bool:
        """Whether a line ends the paragraph before it by opening a block."""
        first = line.lstrip(" ")[:1]
        if first in "`~" and _FENCE.match(line) or first == "#" and _ATX.match(line) or first == ">" and _QUOTE.match(line):
            return True
        if first in "*-_" and _RULE.match(line):
            return True
        if (first in "-+*" or first == "1") and (m := _ITEM.match(line)) and line[m.end() :].strip() and (first in "-+*" or m[2][:-1] == "1"):
            return True
        return first == "<" and any(o.match(line) for o, _ in _HTML_OPEN)

    def quote(self, lines: list[str], i: int) -> int:
        inner, lazy = [], False
        while i < len(lines):
            line = lines[i]
            if m := _QUOTE.match(line):
                inner.append(line[m.end() :])
                lazy = bool(inner[-1].strip()) and not self.interrupts(inner[-1])
            elif lazy and line.strip() and not self.interrupts(line):
                inner.append(line.strip())
            else:
                break
            i += 1
        self.blocks(inner, False)
        return i

    def list(self, lines: list[str], i: int, m: re.Match) -> int:
        kind = m[2][-1]
        items: list[list[str]] = []
        loose, blank = False, False
        while i < len(lines):
            line = lines[i]
            m = _ITEM.match(line)
            if not m or m[2][-1] != kind or _RULE.match(line):
                break
            loose |= blank and bool(items)
            rest = line[m.end() :].replace("\t", "    ", 1)
            pad = len(rest) - len(rest.lstrip(" "))
            pad = 1 if not rest.strip() or pad > 4 else pad
            width = m.end() + pad
            item = [rest[pad:]]
            i, blank = i + 1, False
            while i < len(lines):
                line = lines[i]
                bare = line.lstrip(" ")
                if not bare.strip():
                    if not blank and len(item) == 1 and not item[0].strip():
                        blank = True
                        i += 1
                        break  # an empty item ends at a blank line
                    item.append("")
                    blank = True
                elif len(line) - len(bare) >= width or line.startswith("\t"):
                    item.append(line[1:] if line[0] == "\t" else line[width:])
                    loose |= blank and len(line) - len(bare) == width
                    blank = False
                elif not blank and not _ITEM.match(line) and not self.interrupts(line) and item[-1].strip():
                    item.append(bare)
                else:
                    break
                i += 1
            items.append(item)
        for item in items:
            while item and not item[-1].strip():
                item.pop()
            if item and (t := _TASK.match(item[0])):
                item[0] = item[0][t.end() :]
            self.blocks(item, not loose)
            self.sink.flush()
        return i

    def html(self, lines: list[str], i: int) -> int:
        """The line after an HTML block that opens here; 0 if none does."""
        for opens, closes in _HTML_OPEN:
            if opens.match(lines[i]):
                while i < len(lines):
                    if closes.search(lines[i]) if closes else not lines[i].strip():
                        return i + 1
                    i += 1
                return i
        if _HTML_ALONE.match(lines[i]):
            while i < len(lines) and lines[i].strip():
                i += 1
            return i
        return 0

    def paragraph(self, lines: list[str], i: int, tight: bool) -> int:
        if i + 1 < len(lines) and "-" in lines[i + 1] and _DELIMITER.match(lines[i + 1]):
            head, wide = self.cells(lines[i]), len(self.cells(lines[i + 1]))
            if len(head) == wide and ("|" in lines[i] or "|" in lines[i + 1]):
                return self.table(lines, i, head)
        body = [lines[i]]
        i += 1
        heading = False
        while i < len(lines):
            line = lines[i]
            if _MAY_END.match(line):
                if not line.strip(" \t"):
                    break
                if _SETEXT.match(line):
                    heading = True
                    i += 1
                    break
                if self.interrupts(line):
                    break
            if "|" in line and i + 1 < len(lines) and _DELIMITER.match(lines[i + 1]) and len(self.cells(line)) == len(self.cells(lines[i + 1])):
                break
            body.append(line)
            i += 1
        text = "\n".join(body)
        while text.lstrip(" ").startswith("[") and (m := _DEFINITION.match(text)):
            text = text[m.end() :]
        if text.strip():
            self.inline(text)
            if heading:
                self.sink.say(self.heading_sep)
            elif not tight:
                self.sink.flush()
        return i

    @staticmethod
    def cells(line: str) -> list[str]:
        line = line.strip()
        line = line[1:] if line.startswith("|") else line
        if line.endswith("|") and not line.endswith("\\|"):
            line = line[:-1]
        return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]

    def table(self, lines: list[str], i: int, head: list[str]) -> int:
        self.sink.table_start()
        self.sink.table_head(True)
        for c in head:
            self.cell(c)
        self.sink.table_head(False)
        i += 2
        while i < len(lines) and lines[i].strip() and not self.interrupts(lines[i]):
            row = self.cells(lines[i])
            for c in (row + [""] * len(head))[: len(head)]:
                self.cell(c)
            self.sink.row_end()
            i += 1
        self.sink.table_end()
        return i

    def cell(self, text: str) -> None:
        self.sink.say("| ")
        self.inline(text)
        self.sink.say(" ")

    def inline(self, text: str) -> None:
        if "\n" in text:
            if "\\\n" in text:
                text = _BREAK.sub("\n", text)
            text = "\n".join([x.strip(" \t") for x in text.split("\n")])  # soft or hard, a break is said as a line feed
        text = text.strip(" \t\n")
        self.sink.say(self.plain(text) if _SPECIAL.search(text) else text)

    def plain(self, text: str) -> str:
        """What a run of inline text says, without its marks."""
        out: list[str] = []
        runs: list[tuple[int, str, int, bool, bool]] = []  # place in out, mark, length, opens, closes
        i, n = 0, len(text)
        while i < n:
            c = text[i]
            if m := _PLAIN.match(text, i):
                out.append(m[0])
                i = m.end()
            elif c == "\\" and i + 1 < n and text[i + 1] in _PUNCTUATION:
                out.append(text[i + 1])
                i += 2
            elif c == "`":
                ticks = _TICKS.match(text, i)[0]
                close = re.compile(rf"(?<!`){ticks}(?!`)").search(text, i + len(ticks))
                if close:
                    code = text[i + len(ticks) : close.start()].replace("\n", " ")
                    out.append(code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code)
                    i = close.end()
                else:
                    out.append(ticks)
                    i += len(ticks)
            elif c in "*_~":
                end = i
                while end < n and text[end] == c:
                    end += 1
                before, after = text[i - 1 : i] if i else " ", text[end : end + 1] or " "
                left = not after.isspace() and (after not in _PUNCTUATION or before.isspace() or before in _PUNCTUATION)
                right = not before.isspace() and (before not in _PUNCTUATION or after.isspace() or after in _PUNCTUATION)
                if c == "_":
                    left, right = left and (not right or before in _PUNCTUATION), right and (not left or after in _PUNCTUATION)
                if c != "~" or end - i <= 2:
                    runs.append((len(out), c, end - i, left, right))
                out.append(text[i:end])
                i = end
            elif c == "[" or c == "!" and text[i + 1 : i + 2] == "[":
                found = self.link(text, i + (c == "!"))
                if found:
                    out.append(self.plain(found[0]))
                    i = found[1]
                else:
                    out.append(text[i : i + 1 + (c == "!")])
                    i += 1 + (c == "!")
            elif c == "<" and (m := _AUTOLINK.match(text, i)):
                out.append(m[1])
                i = m.end()
            elif c == "<" and (m := _INLINE_HTML.match(text, i)):
                i = m.end()
            elif c == "&" and (m := _ENTITY.match(text, i)) and (said := html.unescape(m[0])) != m[0]:
                out.append(said)
                i = m.end()
            else:
                out.append(c)
                i += 1
        self.emphasis(out, runs)
        return "".join(out)

    @staticmethod
    def emphasis(out: list[str], runs: list[tuple[int, str, int, bool, bool]]) -> None:
        """Marks that pair up are taken out of ``out``."""
        opened: dict[str, list[list[int]]] = {"*": [], "_": [], "~": []}
        for place, mark, size, opens, closes in runs:
            stack = opened[mark]
            left = size
            while closes and left and stack:
                if mark == "~" and stack[-1][1] != size:
                    break
                used = min(left, stack[-1][1]) if mark == "~" else min(left, stack[-1][1], 2)
                left -= used
                stack[-1][1] -= used
                out[stack[-1][0]] = mark * stack[-1][1]
                begin = stack[-1][0]
                if not stack[-1][1]:
                    stack.pop()
                for other in opened.values():  # marks inside a pair open nothing outside it
                    if other is not stack:
                        while other and other[-1][0] > begin:
                            other.pop()
            out[place] = mark * left
            if opens and left:
                stack.append([place, left])

    def link(self, text: str, i: int) -> tuple[str, int] | None:
        """The text of a link that opens at ``i`` and where it ends."""
        depth, j, n = 0, i, len(text)
        while j < n:
            c = text[j]
            if c == "\\":
                j += 1
            elif c == "`":
                ticks = _TICKS.match(text, j)[0]
                close = re.compile(rf"(?<!`){ticks}(?!`)").search(text, j + len(ticks))
                j = close.end() - 1 if close else j + len(ticks) - 1
            elif c == "[":
                depth += 1
            elif c == "]":
                depth -= 1
                if not depth:
                    break
            j += 1
        if j >= n:
            return None
        inner, end = text[i + 1 : j], j + 1
        if m := _TARGET.match(text, end):
            return inner, m.end()
        if m := re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, end):
            if _name(m[1] or inner) in self.names:
                return inner, m.end()
        return (inner, end) if _name(inner) in self.names else None
