"""Column functions over text: normalisation, Markdown, hashing and literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fix_text(text: Column) -> Column:
    """Line feeds only, no blanks at line ends, exactly one line feed at the end; empty stays empty. (FN-01, SNK-09)"""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?md)[ \t]+$", "")
    body = F.regexp_replace(lines, r"\n+\z", "")
    return F.when(text == "", text).otherwise(F.concat(body, F.lit("\n")))


def slugify(text: Column, default: str = "ethos") -> Column:
    """Lower case, other characters than a-z and 0-9 as single hyphens, none at the ends. (FN-02)"""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.when(slug == "", F.lit(default)).otherwise(slug)


# Steps of markdown_plain as pattern and replacement, with Python's reading of them. (FN-03)
PLAIN_STEPS = (
    (r"(?s)```.*?```", ""),
    (r"`([^`]+)`", "$1"),
    (r"\[(.*?)\]\([^)]+\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"(?md)^#+\s*", ""),
    (r"(?md)^\s*[-*]\s+", ""),
)


def markdown_plain(text: Column) -> Column:
    """Text of Markdown: fences dropped, code, links and emphasis unwrapped, heading and bullet marks off, white space
    collapsed. (FN-03)"""
    for pattern, by in PLAIN_STEPS:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_rule(text: Column) -> Column:
    """Trimmed Markdown without a horizontal rule at its end."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+\z", ""), r"\n---\s*\z", "")


def summarize(text: Column, fallback: str = "No summary available.", limit: int = 240) -> Column:
    """The first sentence of the first paragraph that isn't a third-level heading, a rule, or blank without its marks, at
    most limit characters; else fallback. Fences go first. (FN-04)"""
    paragraphs = F.transform(F.split(F.regexp_replace(without_rule(text), "(?s)```.*?```", ""), r"\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+\z", ""))
    plain = F.transform(F.filter(paragraphs, lambda p: (p != "") & (p != "---") & ~F.startswith(p, F.lit("### "))), markdown_plain)
    first = F.get(F.filter(plain, lambda p: p != ""), 0)
    picked = F.get(F.transform(F.array(first), lambda p: F.when(F.regexp_like(p, F.lit(r"^.+?[.!?](\s|\z)")), F.regexp_extract(p, r"^(.+?[.!?])(?:\s|\z)", 1)).otherwise(p)), 0)
    return F.coalesce(F.rtrim(F.substring(picked, 1, limit)), F.lit(fallback))


def first_rule(text: Column, rules: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """The name of the first rule of which a keyword occurs, as a substring, in lower-cased text. (FN-05)"""
    low = F.lower(text)
    out = F.lit(default)
    for words, name in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def cache_key(*parts: Column) -> Column:
    """SHA-256 of NUL-joined parts; null parts count as empty, so none shifts another. (FN-07; FN-08 of model path and content)"""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def sentences(text: Column) -> Column:
    """How many of . ! ? stand before white space or the end. (FN-10)"""
    return F.regexp_count(text, F.lit(r"[.!?](\s|\z)"))


# The heading behind which references stand, an entry, and an entry with a folder. (FN-12)
SEE_ALSO = r"(?imd)^See Also:\s*$"
SEE_ENTRY = r"(?md)^\s+([A-Za-z0-9_-]+\.md)\s*[:|-]"
SEE_PATH = r"(?md)^\s+([A-Za-z0-9_/-]+/[A-Za-z0-9_-]+\.md)\s*[:|-]"


def see_also(docstring: Column, entry: str = SEE_ENTRY) -> Column:
    """Distinct sorted references behind the first line that is only 'See Also:'. (FN-12)"""
    parts = F.split(docstring, SEE_ALSO, 2)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(F.get(parts, 1), F.lit("")), F.lit(entry), F.lit(1))))


def starts_with_keyword(literal: Column, keywords: tuple[str, ...]) -> Column:
    """The first keyword that upper-cased, trimmed text starts with, not followed by an ASCII letter or digit. (FN-14)"""
    return F.regexp_extract(F.upper(F.trim(literal)), f"^({'|'.join(map(re.escape, keywords))})(?:[^0-9A-Za-z]|$)", 1)


def suspicious(text: Column, marks: tuple[str, ...]) -> Column:
    """Whether a mark occurs, in either case. (FN-15)"""
    low, out = F.lower(text), F.lit(False)
    for m in marks:
        out = out | F.contains(low, F.lit(m.lower()))
    return out


def version_requirement(spec: Column) -> Column:
    """x.y of the first >=, ~= or == clause, empty if none. (FN-16)"""
    return F.regexp_extract(spec, r"(?:>=|~=|==)\s*(\d+\.\d+)", 1)


def duration_literal(seconds: Column) -> Column:
    """'<n>s', an hour for durations that aren't positive. (FN-17)"""
    return F.concat(F.when(seconds > 0, seconds).otherwise(F.lit(3600)).cast("string"), F.lit("s"))


def inline_content(template: Column, content: Column, mark: str) -> Column:
    """The first mark of a template replaced by content, else content behind a blank line. (FN-18)"""
    at = F.locate(mark, template)
    return F.when(at > 0, F.concat(template.substr(F.lit(1), at - 1), content, template.substr(at + len(mark), F.lit(2**31 - 1)))).otherwise(F.concat(template, F.lit("\n\n"), content))


def line_at(text: Column, n: Column, missing: str = "<unknown>") -> Column:
    """The trimmed line n, counted from 1. (FN-22)"""
    return F.coalesce(F.trim(F.when(n > 0, F.try_element_at(F.split(text, "\n"), n))), F.lit(missing))


def without_block(text: Column, begin: str, end: str) -> Column:
    """Text without the part from begin to end, the rest joined by a blank line. (FN-23)"""
    a, z = F.locate(begin, text), F.locate(end, text)
    head = F.regexp_replace(text.substr(F.lit(1), a - 1), r"\s+\z", "")
    tail = F.regexp_replace(text.substr(z + len(end), F.lit(2**31 - 1)), r"^\s+", "")
    joined = F.when(head == "", tail).when(tail == "", head).otherwise(F.concat(head, F.lit("\n\n"), tail))
    return F.when((a > 0) & (z > a), joined).otherwise(text)


def with_block(text: Column, begin: str, end: str, body: Column) -> Column:
    """The block put at the end once: an older one goes first, so a second call changes nothing. (FN-24)"""
    rest = F.regexp_replace(without_block(text, begin, end), r"\s+\z", "")
    block = F.concat(F.lit(begin), F.lit("\n"), body, F.lit("\n"), F.lit(end))
    return F.when(rest == "", block).otherwise(F.concat(rest, F.lit("\n\n"), block))


def without_blocks(text: Column, begin: str, end: str) -> Column:
    """Text without all parts from a mark that starts with begin to one that starts with end, blank lines squeezed. (FN-25)"""
    bare = F.regexp_replace(text, f"(?s){re.escape(begin)}.*?{re.escape(end)}.*?-->", "")
    body = F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def toml_string(text: Column) -> Column:
    """A basic TOML string literal. (FN-26)"""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def pattern_or_never(pattern: str) -> str:
    """An empty pattern matches nothing. (FN-27)"""
    return pattern or "a^"


def count_lines(text: Column) -> Column:
    """Lines behind which trailing line feeds don't count; empty text has none. (AGG-11)"""
    body = F.regexp_replace(text, r"\n+\z", "")
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, "\n")))


def normal_path(path: Column) -> Column:
    """Forward slashes, one leading ./ off. (FN-06)"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def glob_regex(pattern: str) -> str:
    """An anchored regex: ** spans directories, * and ? stay within one. (FLT-12)"""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        c = pattern[i]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        i += 1
    return f"^{out}$"


def normalized_list(items: Column) -> Column:
    """Trimmed items that aren't blank, in order. (PRJ-01)"""
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def distinct_in_order(items: Column, limit: int | None = None) -> Column:
    """First occurrences of trimmed items that aren't blank. (SRT-02, SRT-07, SRT-03)"""
    out = F.array_distinct(normalized_list(items))
    return F.slice(out, 1, limit) if limit else out
