"""Wrapping of texts of several lines."""

from __future__ import annotations

import textwrap

WIDTH = 70


def wrapped(text: str) -> str:
    """A text of several lines wrapped at WIDTH: fences, headings and lines that are indented by four stay as they are; list
    items are indented below their mark, other lines as they begin. (FN-19)"""
    out, fenced = [], False
    for line in text.splitlines():
        bare = line.strip()
        fence = bare.startswith("```")
        if fence or fenced or not bare or bare.startswith("#") or line.startswith("    "):
            out.append(line)
            fenced ^= fence
            continue
        indent = line[: len(line) - len(line.lstrip())]
        mark, gap, rest = bare.partition(" ")
        item = gap and (mark in ("-", "*", "+") or mark[:-1].isdigit() and mark[-1] == ".")
        first = indent + mark + " " * (1 + len(rest) - len(rest.lstrip())) if item else indent
        out.append(textwrap.fill(rest.lstrip() if item else bare, WIDTH, initial_indent=first, subsequent_indent=" " * len(first) if item else indent, break_long_words=False, break_on_hyphens=False))
    return "\n".join(out)
