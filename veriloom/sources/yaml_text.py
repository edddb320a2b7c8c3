"""YAML of the kind that settings are written in: block and flow collections, plain, quoted, literal and folded scalars, comments,
anchors, aliases, merge keys and tags of plain types; no explicit keys, no anchors on keys. Reading gives what JSON can hold; a
text outside this part raises, as do an alias inside its own anchor and aliases that expand to over LIMIT values. (SRC-01,
SRC-02, SNK-08)"""

from __future__ import annotations

import json
import re
import textwrap

from veriloom.functions.wrap import WIDTH, wrapped

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#:]*?(?:[:#](?=\S)[^#:]*?)*|[-?:](?=\S)[^#:]*?)\s*:(?=\s|$)""")
_BLOCK = re.compile(r"([|>])([+-]?)([1-9]?)([+-]?)\s*(?:#.*)?$")
_INT, _FLOAT = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)$"), re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9]+)(?:[eE][-+][0-9]+)?$")
_WORDS = {**dict.fromkeys(("", "~", "null", "Null", "NULL")), **dict.fromkeys(("true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON"), True), **dict.fromkeys(("false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF"), False)}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "/": "/", " ": " ", "e": "\x1b", "a": "\a", "b": "\b"}


#: Values that the aliases of one document may give in all.
LIMIT = 1_000_000
_PROPERTY, _ALIAS = re.compile(r"([&!])([^\s,\[\]{}]*)\s*"), re.compile(r"\*([^\s,\[\]{}]+)")


def plain(text: str) -> object:
    """The value of a plain scalar."""
    if text in _WORDS:
        return _WORDS[text]
    if _INT.match(text):
        return int(text.replace("_", ""))
    return float(text.replace("_", "")) if _FLOAT.match(text) else text


def _unquoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")
    code = lambda m: chr(int(m[0][2:], 16)) if m[0][1] in "xuU" else ESCAPES.get(m[0][1], m[0][1])
    return re.sub(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", code, text[1:-1], flags=re.S)


def _bare(text: str) -> str:
    """Without a comment at the end."""
    return re.sub(r"(?:^|\s+)#.*$", "", text).rstrip()


def _size(value: object) -> int:
    below = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 1 + sum(map(_size, below))


def _merged(own: dict) -> dict:
    """A mapping whose merge key gives the entries that it doesn't have itself; of several mappings the first that has one."""
    if "<<" not in own:
        return own
    given = own["<<"] if isinstance(own["<<"], list) else [own["<<"]]
    if not all(isinstance(x, dict) for x in given):
        raise ValueError("a merge key needs mappings")
    out: dict = {}
    for x in (*reversed(given), {k: v for k, v in own.items() if k != "<<"}):
        out.update(x)
    return out


def _tagged(tag: str, value: object) -> object:
    """A value under a tag; a plain scalar comes as text."""
    kinds = {"map": dict, "seq": list}
    name = tag.removeprefix("!") if tag.startswith("!") else "" if not tag else None
    if name in kinds and isinstance(value, kinds[name]) or name in ("", "str") and isinstance(value, str):
        return value
    if name in ("int", "float", "bool", "null") and isinstance(value, str):
        found = plain(value)
        if name == "float" and type(found) is int:
            return float(found)
        if type(found).__name__ == {"null": "NoneType"}.get(name, name):
            return found
    raise ValueError(f"the tag !{tag} isn't read on this value")


class _Anchors:
    """Anchored values of a document."""

    def __init__(self):
        self.values, self.sizes, self.spent = {}, {}, 0

    def keep(self, name: str, value: object) -> None:
        self.values[name], self.sizes[name] = value, _size(value)

    def alias(self, name: str) -> object:
        if name not in self.values:
            raise ValueError(f"*{name} has no anchor before it")
        self.spent += self.sizes[name]
        if self.spent > LIMIT:
            raise ValueError("aliases give too many values")
        return self.values[name]

    def under(self, marks: list[tuple[str, str]], read) -> object:
        """The value that read gives (its argument tells how plain scalars are read), under its anchor and tag."""
        tag = next((name for mark, name in marks if mark == "!"), None)
        for mark, name in marks:
            if mark == "&":
                self.values.pop(name, None)  # an alias inside refers to nothing
        value = read(plain if tag is None else str)
        value = value if tag is None else _tagged(tag, value)
        for mark, name in marks:
            if mark == "&":
                self.keep(name, value)
        return value


def _properties(text: str, at: int = 0) -> tuple[list[tuple[str, str]], int]:
    marks = []
    while m := _PROPERTY.match(text, at):
        marks.append((m[1], m[2]))
        at = m.end()
    return marks, at


class _Flow:
    """A flow collection or a quoted scalar."""

    def __init__(self, text: str, anchors: _Anchors | None = None):
        self.text, self.at, self.anchors = text, 0, anchors or _Anchors()

    def skip(self) -> str:
        m = re.compile(r"(?:\s+|(?<=\s)#[^\n]*)*").match(self.text, self.at)
        self.at = m.end()
        return self.text[self.at : self.at + 1]

    def value(self, form=plain) -> object:
        c = self.skip()
        if c and c in "&!":
            marks, self.at = _properties(self.text, self.at)
            return self.anchors.under(marks, self.value)
        if c == "*":
            m = _ALIAS.match(self.text, self.at)
            if not m:
                raise ValueError("an alias needs a name")
            self.at = m.end()
            return self.anchors.alias(m[1])
        if c == "[":
            return self.items("]", lambda: self.value())
        if c == "{":
            return _merged(dict(self.items("}", self.pair)))
        if c and c in "\"'":
            m = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'', re.S).match(self.text, self.at)
            if not m:
                raise ValueError("a quoted text doesn't end")
            self.at = m.end()
            return _unquoted(re.sub(r"[ \t]*\n\s*", " ", m[0]))
        m = re.compile(r"(?:[^,\[\]{}:#]|:(?=[^\s,\]}])|(?<=\S)#)*").match(self.text, self.at)
        self.at = m.end()
        return form(" ".join(m[0].split()))

    def pair(self) -> tuple:
        key = self.value()
        if self.skip() != ":":
            return str(key), None
        self.at += 1
        return str(key), self.value() if self.skip() not in (",", "}") else None

    def items(self, end: str, one) -> list:
        self.at += 1
        out = []
        while (c := self.skip()) != end:
            if not c:
                raise ValueError(f"{end} is missing")
            out.append(one())
            if self.skip() == ",":
                self.at += 1
            elif self.skip() != end:
                raise ValueError(f"{end} or , is missing")
        self.at += 1
        return out


class _Reader:
    def __init__(self, text: str):
        self.lines, self.i, self.anchors = text.split("\n"), 0, _Anchors()

    def here(self) -> tuple[int, str] | None:
        """Indent and text of the next line that says something."""
        while self.i < len(self.lines):
            line = self.lines[self.i]
            bare = line.strip()
            if bare and bare[0] != "#":
                indent = len(line) - len(line.lstrip(" "))
                if line[indent] == "\t":
                    raise ValueError(f"line {self.i + 1}: a tab indents")
                return indent, line[indent:].rstrip()
            self.i += 1
        return None

    def node(self, least: int, form=plain) -> object:
        at = self.here()
        if at is None or at[0] < least:
            return None
        indent, text = at
        if text == "-" or text.startswith("- "):
            return self.sequence(indent)
        if text[0] not in "[{" and _KEY.match(text):
            return self.mapping(indent)
        self.i += 1
        return self.value(text, least - 1, form)

    def sequence(self, indent: int) -> list:
        out = []
        while (at := self.here()) and at[0] == indent and (at[1] == "-" or at[1].startswith("- ")):
            rest = at[1][1:].lstrip()
            if not _bare(rest):
                self.i += 1
                out.append(self.node(indent + 1))
                continue
            inner = indent + len(at[1]) - len(rest)
            if rest.startswith("- ") or rest[0] not in "[{" and _KEY.match(rest):
                self.lines[self.i] = " " * inner + rest  # the item's own lines begin where its first one does
                out.append(self.node(inner))
            else:
                self.i += 1
                out.append(self.value(rest, indent))
        return out

    def value(self, text: str, indent: int, form=plain, flush: bool = False) -> object:
        """A value that begins with text, or below it where there is none; indent is that of its parent, flush tells whether
        a sequence may begin there as well."""
        if _bare(text) and text[0] in "&!":
            marks, at = _properties(text)
            return self.anchors.under(marks, lambda form: self.value(text[at:], indent, form, flush))
        if _bare(text):
            return self.scalar(text, indent, form)
        below = self.here()
        if flush and below and below[0] == indent and (below[1] == "-" or below[1].startswith("- ")):
            return self.sequence(indent)
        found = self.node(indent + 1, form)
        return "" if found is None and form is str else found

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        quoted = False
        while (at := self.here()) and at[0] == indent and (m := _KEY.match(at[1])) and not at[1].startswith("- "):
            key = _unquoted(m[1]) if m[1][0] in "\"'" else m[1].strip()
            rest = at[1][m.end() :].strip()
            self.i += 1
            out[key] = self.value(rest, indent, flush=True)
            quoted = quoted or key == "<<" and m[1][0] in "\"'"
        if (at := self.here()) and at[0] > indent:
            raise ValueError(f"line {self.i + 1}: unexpected indent")
        return out if quoted else _merged(out)

    def scalar(self, text: str, indent: int, form=plain) -> object:
        """A value that begins with text; indent is that of its parent."""
        m = _ALIAS.match(text)
        if m and not _bare(" " + text[m.end() :].strip()).strip():
            return self.anchors.alias(m[1])
        if text[0] in "&*!%@`":
            raise ValueError(f"line {self.i}: {text[0]} isn't read here")
        m = _BLOCK.match(text)
        if m:
            return self.block(m[1], m[2] or m[4], int(m[3] or 0), indent)
        if text[0] in "[{\"'":
            while True:
                flow, spent = _Flow(text, self.anchors), self.anchors.spent
                try:
                    value = flow.value(form)
                    break
                except ValueError:
                    self.anchors.spent = spent
                    if self.i >= len(self.lines):
                        raise
                    text, self.i = f"{text}\n{self.lines[self.i]}", self.i + 1
            if _bare(" " + text[flow.at :].strip()).strip():
                raise ValueError(f"line {self.i}: text behind a value")
            return value
        parts = [_bare(text)]
        while (at := self.here()) and at[0] > indent:
            parts.append(_bare(at[1]))
            self.i += 1
        if any(_KEY.match(p) for p in parts[1:]) or _KEY.match(parts[0]):
            raise ValueError(f"line {self.i}: a mapping isn't allowed here")
        return form(" ".join(parts))

    def block(self, style: str, chomp: str, given: int, indent: int) -> str:
        rows = []
        depth = indent + given if given else None
        while self.i < len(self.lines):
            line = self.lines[self.i]
            own = len(line) - len(line.lstrip(" "))
            if line.strip():
                if depth is None:
                    depth = own
                if own < depth or own <= indent:
                    break
            rows.append(line[depth:] if depth is not None and line.strip() else "")
            self.i += 1
        while rows and not rows[-1]:
            rows.pop()
        text = "\n".join(rows)
        if style == ">":
            text = re.sub(r"(?<=[^\n])\n(?=[^\n \t])(?<![ \t]\n)", " ", text)
            text = re.sub(r"\n(\n+)(?=[^\s])", r"\1", text)
        return text + ("" if chomp == "-" or not text else "\n")


def documents(text: str) -> list:
    """All documents of a stream. (CHK-14)"""
    parts = re.split(r"(?m)^(?:---|\.\.\.)[ \t]*(?:#.*)?$", text.removeprefix("﻿").replace("\r\n", "\n"))
    out = []
    for k, part in enumerate(parts):
        if k in (0, len(parts) - 1) and len(parts) > 1 and not re.sub(r"(?m)^\s*(?:#.*|%.*)?$", "", part).strip():
            continue
        reader = _Reader(part)
        value = reader.node(0)
        if reader.here():
            raise ValueError(f"line {reader.i + 1}: unexpected text")
        out.append(value)
    return out


def load(text: str) -> object:
    """The one document of a text; an empty text is an empty mapping."""
    found = documents(text)
    if len(found) > 1:
        raise ValueError("more than one document")
    return found[0] if found and found[0] is not None else {}


def _scalar(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if not isinstance(value, str):
        return json.dumps(value)
    safe = value and value == value.strip() and plain(value) == value and not re.search(r"[:#](?:\s|$)|\s#|^[-?:,\[\]{}#&*!|>'\"%@`]|[\x00-\x1f]", value) and not re.match(r"\d{4}-\d\d?-\d\d?", value)
    return value if safe else "'" + value.replace("'", "''") + "'" if not re.search(r"[\x00-\x1f]", value) else json.dumps(value, ensure_ascii=False)


def dump(value: object, indent: int = 0) -> str:
    """A mapping or list as block YAML, two blanks a level, lists in by two; texts of several lines as literals, long ones
    folded. (SNK-08)"""
    pad, out = " " * indent, []
    pairs = [(f"{_scalar(str(k))}:", v) for k, v in value.items()] if isinstance(value, dict) else [("-", v) for v in value]
    for head, v in pairs:
        if isinstance(v, str) and "\n" in v:
            body = wrapped(v)
            keep = "" if v.endswith("\n") else "-"
            out += [f"{pad}{head} |{keep}", *(f"{pad}  {x}" if x else "" for x in body.rstrip("\n").split("\n"))]
        elif isinstance(v, str) and len(v) > 88 and v.strip() and any(c.isspace() for c in v.strip()) and not v.strip().startswith(("http://", "https://", "#", "```")):
            out += [f"{pad}{head} >-", *(f"{pad}  {x}" for x in textwrap.wrap(v.strip(), WIDTH, break_long_words=False, break_on_hyphens=False))]
        elif isinstance(v, (dict, list)) and v:
            body = dump(v, indent + 2).rstrip("\n")
            out.append(f"{pad}- {body[indent + 2 :]}" if head == "-" else f"{pad}{head}\n{body}")
        else:
            out.append(f"{pad}{head} {('{}' if isinstance(v, dict) else '[]') if isinstance(v, (dict, list)) else _scalar(v)}")
    return "\n".join(out) + "\n"
