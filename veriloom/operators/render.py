"""Documents from principles and repository contexts: each is one row of (bundle, path, content). (RND, SRT-03, SRT-08)

A bundle row holds bundle, root_name, title, overview, repo (the struct of principles.repo_context) and profile_notes (map of
an agent's notes; agents without a profile are absent). Principles are rows with a bundle column. A bundle's principles meet
in its documents, which hold them all; bundles are independent.

The notice, the licence lines and the names in the fixed texts below are the user's: see Layout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.operators.principles import AGENTS


@dataclass(frozen=True)
class Layout:
    """Lines above each document, the notice of generated ones, the layer's heading, the overlay's file name, the prefix of
    a document title, and the title of one without any."""

    head: tuple[str, ...] = ()
    notice: str = "<!-- Generated. Edit the sources, then regenerate. -->"
    layer: str = "Shared Ethos"
    overlay: str = "overlay.yml"
    prefix: str = "ETHOS.md:"
    untitled: str = "Engineering Ethos"


def joined(rows: DataFrame, by: list[str], order: list[str], line: Column, sep: str = "\n") -> DataFrame:
    """(by, document): the lines of each group in order. (RND-08)"""
    pair = F.struct(*order, line.alias("_l"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["_l"]), sep).alias("document"))


def document(parts: Column, layout: Layout = Layout()) -> Column:
    """An array of lines as a text below the layout's head, with one line feed at the end."""
    head = "\n".join([*layout.head, "", ""]) if layout.head else ""
    return F.concat(F.lit(head), F.regexp_replace(F.array_join(parts, "\n"), r"\s+\z", ""), F.lit("\n"))


def _array(*items: str | Column) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in items])


def _bullets(items: Column) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit("- "), x))


def _if(condition: Column, *parts: Column) -> Column:
    return F.when(condition, F.concat(*parts)).otherwise(F.array().cast("array<string>"))


def numbered(p: Column) -> Column:
    return F.concat(F.lpad(p["ord"].cast("string"), F.greatest(F.lit(2), F.char_length(p["ord"].cast("string"))), F.lit("0")), F.lit(". "), p["title"])


def main_line(p: Column) -> Column:
    """The directive, or without one the summary."""
    return F.when(p["directive"] != "", p["directive"]).otherwise(p["summary"])


def short_refs(items: Column, limit: int = 3) -> Column:
    """The first few, joined by bars. (SRT-04)"""
    return F.array_join(F.transform(F.slice(items, 1, limit), lambda x: F.trim(x)), " | ")


def principle_lines(principles: Column) -> Column:
    """A line for each principle of an array, and one below it with its short references. (SRT-08)"""
    tags = lambda p: F.when(F.size(p["tags"]) > 0, F.concat(F.lit(" [tags: "), F.array_join(p["tags"], ", "), F.lit("]"))).otherwise("")
    first = lambda p: F.concat(F.lit("- `"), numbered(p), F.lit("`: "), main_line(p), tags(p))
    refs = lambda p: _if(F.size(p["quick_ref"]) > 0, F.array(F.concat(F.lit("  Quick ref: "), short_refs(p["quick_ref"]))))
    return F.flatten(F.transform(principles, lambda p: F.concat(F.array(first(p)), refs(p))))


def bundled(bundles: DataFrame, principles: DataFrame) -> DataFrame:
    """bundles with `principles`: an array in the order of their rank, and `name`: the repository's, or its root's."""
    columns = [c for c in principles.columns if c != "bundle"]
    ranked = principles.groupBy(F.col("bundle").alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("_o"), F.lower("title").alias("_t"), "id", F.struct(*columns).alias("p"))), _by_rank), lambda x: x["p"]).alias("principles"))
    return _named(bundles).join(ranked, F.col("bundle") == F.col("_b")).drop("_b")


def _named(bundles: DataFrame) -> DataFrame:
    return bundles.withColumn("name", F.when(F.col("repo.name") != "", F.col("repo.name")).otherwise(F.col("root_name")))


def _by_rank(a: Column, b: Column) -> Column:
    key = lambda x: F.struct(x["_o"], x["_t"], x["id"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def _notes(agent: str) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.element_at("repo.agent_notes", agent), none)


def _profile(agent: str) -> Column:
    return F.coalesce(F.element_at("profile_notes", agent), F.array().cast("array<string>"))


def _repo_lines(agent: str | None = None) -> Column:
    """Commands and paths as bullets."""
    entry = lambda k, v: F.concat(F.lit("- `"), k, F.lit("`: `"), v, F.lit("`"))
    commands = F.transform(F.filter(F.map_entries("repo.commands"), lambda e: F.size(e["value"]) > 0), lambda e: entry(e["key"], F.array_join(e["value"], "; ")))
    paths = F.transform(F.map_entries("repo.paths"), lambda e: entry(e["key"], e["value"]))
    return F.concat(
        _if(F.size(commands) > 0, _array("", "## Commands"), commands),
        _if(F.size(paths) > 0, _array("", "## Key Paths"), paths),
        _if(F.size("repo.notes") > 0, _array("", "## Repo Notes"), _bullets(F.col("repo.notes"))),
    )


def _context() -> Column:
    """The section on the repository, if anything is known of it."""
    any_of = (F.col("repo.name") != "") | (F.col("repo.overview") != "") | (F.size("repo.notes") > 0)
    overview = _if(F.col("repo.overview") != "", F.array(F.concat(F.lit("- Overview: "), F.col("repo.overview"))))
    return any_of, overview


def ethos_part(p: Column) -> Column:
    """A principle's part of the full document."""
    lines = F.concat(
        F.array(F.lit(""), F.concat(F.lit("## "), numbered(p)), F.lit(""), p["summary"], F.lit("")),
        _if(p["directive"] != "", F.array(F.lit("### Directive"), p["directive"], F.lit(""))),
        _if(F.size(p["quick_ref"]) > 0, _array("### Quick Ref"), _bullets(p["quick_ref"]), _array("")),
        _if(F.size(p["tags"]) > 0, F.array(F.lit("### Tags"), F.concat(F.lit("- "), F.array_join(p["tags"], ", ")), F.lit(""))),
        F.flatten(F.transform(p["sections"], lambda s: F.array(F.concat(F.lit("### "), s["title"]), s["body"], F.lit("")))),
    )
    return F.array_join(lines, "\n")


def ethos(layout: Layout = Layout()) -> Column:
    """The full document, of `parts`. (RND-01)"""
    title = F.when(F.trim("title") == "", layout.untitled).otherwise(F.trim("title"))
    bare = F.trim(F.when(F.startswith(title, F.lit(layout.prefix)), F.substring(title, len(layout.prefix) + 1, 2**31 - 1)).otherwise(title))
    any_of, overview = _context()
    context = _if(any_of, F.array(F.lit("## Repo Context"), F.concat(F.lit("- Repo: `"), F.col("name"), F.lit("`"))), overview, _bullets(F.col("repo.notes")), _array(""))

    lines = F.concat(
        F.array(F.lit(layout.notice), F.concat(F.lit("# "), F.when(bare == "", layout.untitled).otherwise(bare)), F.lit("")),
        _if(F.col("overview") != "", F.array(F.col("overview"), F.lit(""))),
        context,
        _array("## Principles"),
        F.col("parts"),
    )
    return document(lines, layout)


def agents_root(layout: Layout = Layout()) -> Column:
    """The root document of the first agent. (RND-02)"""
    notes = F.concat(_profile("codex"), _notes("codex"))
    shared = F.when(F.col("repo.overview") != "", F.concat(F.lit("- Overview: "), F.col("repo.overview"))).when(F.col("overview") != "", F.concat(F.lit("- Shared ethos: "), F.replace("overview", F.lit("\n"), F.lit(" "))))
    lines = F.concat(
        F.array(F.lit(layout.notice), F.lit("# AGENTS.md"), F.lit(""), F.lit("## Purpose"), F.concat(F.lit("- Repo: `"), F.col("name"), F.lit("`"))),
        F.array_compact(F.array(shared)),
        _repo_lines(),
        _array("", "## Non-Negotiable Ethos"),
        principle_lines(F.col("principles")),
        _array("", "## Detail Docs", "- Deep reference notes live in `.agents/ethos/README.md` and the linked per-principle docs."),
        _if(F.size(notes) > 0, _array("", "## Codex Notes"), _bullets(notes)),
    )
    return document(lines, layout)


# Fixed texts of the root documents and of what is added to hand-written ones. (RND-03 to RND-07)
CLAUDE_NOTES = ("- Keep the shared contract in `AGENTS.md`; use this file only for Claude-specific guidance.", "- The imported memory index mirrors Claude's memory style and points at one deep note per ethos entry.")
CLAUDE_LAST = "- Open the linked ethos note before changing architecture, validation, error handling, security, or delegation behavior."
GEMINI_NOTES = ("- `AGENTS.md` is the durable project contract for this repository.", "- Prefer targeted reads of `.agents/ethos/README.md` and individual detail docs instead of inlining the full corpus.")
ADDED = {
    "codex": (
        "- Keep the hand-written repo guidance above authoritative for repo-specific operations and edge cases.",
        "- Shared ethos index: `.agents/ethos/README.md`.",
        "- Per-principle detail docs: `.agents/ethos/*.md`.",
        "- Optional prompt addon: `.agent-context/prompt-addons/codex.md`.",
    ),
    "claude": (
        "- Keep the existing repo-specific Claude guidance above; this section is only the generated ethos layer.",
        "- Shared ethos index: `.agents/ethos/README.md`.",
        "- Claude memory index: `.claude/ethos/MEMORY.md`.",
        "- Optional prompt addon: `.agent-context/prompt-addons/claude.md`.",
        "- Open the matching ethos note before changing architecture, validation, error handling, security, or delegation behavior.",
    ),
    "gemini": (
        "- Keep the hand-written repo guidance above; use this generated section as the shared ethos layer.",
        "- Durable repo contract: `AGENTS.md`.",
        "- Shared ethos index: `.agents/ethos/README.md`.",
        "- Optional prompt addon: `.agent-context/prompt-addons/gemini.md`.",
    ),
}
IMPORTS = {"CLAUDE.md": ("@AGENTS.md", "@.claude/ethos/MEMORY.md"), "GEMINI.md": ("@AGENTS.md",)}
TOPICS = {
    "AGENTS.md": ("repo commands", "key paths", "repo operating notes"),
    "CLAUDE.md": ("Claude imports", "memory links", "Claude-specific workflow notes"),
    "GEMINI.md": ("Gemini root guidance", "linked detail docs", "repo operating notes"),
}
ROOTS = ("AGENTS.md", "CLAUDE.md", "GEMINI.md")


def claude_root(layout: Layout = Layout()) -> Column:
    """The root document that imports the first one. (RND-03)"""
    notes = F.when(F.element_at("profile_notes", "claude").isNotNull(), _bullets(_profile("claude"))).otherwise(_array(*CLAUDE_NOTES))
    return document(F.concat(_array(layout.notice, *IMPORTS["CLAUDE.md"], "", "# Claude Code", ""), notes, _array(CLAUDE_LAST), _bullets(_notes("claude"))), layout)


def gemini_root(layout: Layout = Layout()) -> Column:
    """The third root document. (RND-04)"""
    notes = F.when(F.element_at("profile_notes", "gemini").isNotNull(), _bullets(_profile("gemini"))).otherwise(_array(*GEMINI_NOTES))
    head = F.array(F.lit(layout.notice), F.lit("@AGENTS.md"), F.lit(""), F.concat(F.lit("# GEMINI.md for "), F.col("name")), F.lit(""))
    return document(F.concat(head, notes, _array(f"- Keep repo-specific conventions in `{layout.overlay}`; regenerate after updating it."), _bullets(_notes("gemini"))), layout)


def addendum(agent: str, layout: Layout = Layout()) -> Column:
    """What is added to a hand-written root document: all principles for the first agent, the first five for the others.
    (RND-05 to RND-07)"""
    head = F.concat(F.array(F.lit(f"## {layout.layer}"), F.concat(F.lit("- Managed additive guidance for `"), F.col("name"), F.lit("`."))), _array(*ADDED[agent]))
    title = f"### {agent.title()} Notes"
    if agent == "codex":
        notes = F.concat(_profile(agent), _notes(agent))
        last = _array(f"- Update `{layout.overlay}` when repo-specific guidance should refine shared ethos behavior.", "", "### Ethos Priorities")
        return document(F.concat(head, last, principle_lines(F.col("principles")), _if(F.size(notes) > 0, _array("", title), _bullets(notes))), layout)
    notes = _notes(agent)
    return document(F.concat(head, _if(F.size(notes) > 0, _array("", title), _bullets(notes)), _array("", "### High-Priority Principles"), principle_lines(F.slice("principles", 1, 5))), layout)


def index(layout: Layout = Layout()) -> Column:
    """The list of all detail documents. (RND-08)"""
    line = lambda p: F.concat(F.lit("- ["), numbered(p), F.lit("]("), p["id"], F.lit(".md) - "), main_line(p))
    return document(F.concat(F.array(F.lit(layout.notice), F.concat(F.lit("# "), F.col("name"), F.lit(" ethos reference")), F.lit(""), F.lit("## Principles")), F.transform("principles", line)), layout)


def memory(layout: Layout = Layout()) -> Column:
    """The memory index. (RND-09)"""
    line = lambda p: F.concat(F.lit("- ["), p["title"], F.lit("](../../.agents/ethos/"), p["id"], F.lit(".md) - "), main_line(p))
    return document(F.concat(F.array(F.lit(layout.notice), F.concat(F.lit("# "), F.col("name"), F.lit(" ethos memory")), F.lit(""), F.lit("## Shared Ethos")), F.transform("principles", line)), layout)


def detail(p: Column, layout: Layout = Layout()) -> Column:
    """A principle's own document. (RND-10)"""
    any_of, overview = _context()
    titled = lambda name, condition, items: _if(condition, _array(f"## {name}"), items, _array(""))
    hints = F.transform(F.array_sort(F.map_entries(p["agent_hints"])), lambda e: F.concat(F.lit("- `"), e["key"], F.lit("`: "), e["value"]))
    repo = _if(any_of, _array("## Repo Context"), _if(F.col("repo.name") != "", F.array(F.concat(F.lit("- Repo: `"), F.col("name"), F.lit("`")))), overview, _bullets(F.col("repo.notes")), _array(""))
    lines = F.concat(
        F.array(F.lit(layout.notice), F.concat(F.lit("# "), numbered(p)), F.lit(""), F.lit("## Summary"), p["summary"], F.lit("")),
        titled("Directive", p["directive"] != "", F.array(p["directive"])),
        titled("Quick Ref", F.size(p["quick_ref"]) > 0, _bullets(p["quick_ref"])),
        titled("Merge Topics", F.size(p["merge_topics"]) > 0, _bullets(p["merge_topics"])),
        titled("Tags", F.size(p["tags"]) > 0, F.array(F.concat(F.lit("- "), F.array_join(p["tags"], ", ")))),
        titled("Related", F.size(p["related"]) > 0, F.transform(p["related"], lambda r: F.concat(F.lit("- ["), r, F.lit("]("), r, F.lit(".md)")))),
        titled("Agent Hints", F.size(hints) > 0, hints),
        repo,
        F.flatten(F.transform(p["sections"], lambda s: F.array(F.concat(F.lit("## "), s["title"]), s["body"], F.lit("")))),
    )
    return document(lines, layout)


def addon(agent: str, layout: Layout = Layout()) -> Column:
    """A short prompt with the first five principles. (RND-11)"""
    top = F.slice("principles", 1, 5)
    main = F.transform(top, lambda p: F.concat(F.lit("- "), p["title"], F.lit(": "), main_line(p)))
    refs = F.transform(F.filter(top, lambda p: F.size(p["quick_ref"]) > 0), lambda p: F.concat(F.lit("- "), p["title"], F.lit(" quick ref: "), short_refs(p["quick_ref"], 2)))
    head = F.array(
        F.lit(f"# {agent.title()} prompt addon"),
        F.lit(""),
        F.concat(F.lit("You are working in `"), F.col("name"), F.lit("`.")),
        F.lit("Treat `AGENTS.md` as the source of truth when it is present."),
        F.lit("If a task touches architecture, validation, error handling, or delegation, consult the matching detail doc under `.agents/ethos/` before acting."),
        F.lit(""),
        F.lit("Core principles:"),
    )
    return document(F.concat(head, main, refs), layout)


def ethos_documents(bundles: DataFrame, principles: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(bundle, path, content): the full document and the two root documents without principles of each bundle that has some.

    A principle's part is made where its row is; a bundle's task only sorts and joins texts. (RND-01, RND-03, RND-04)
    """
    p = F.struct(*[c for c in principles.columns if c != "bundle"])
    parts = principles.select(F.col("bundle").alias("_b"), F.struct(F.col("ord").alias("_o"), F.lower("title").alias("_t"), "id", ethos_part(p).alias("part")).alias("x"))
    whole = _named(bundles).join(parts.groupBy("_b").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["part"]).alias("parts")), F.col("bundle") == F.col("_b"))
    fixed = [("ETHOS.md", ethos), ("CLAUDE.md", claude_root), ("GEMINI.md", gemini_root)]
    return _exploded(whole, [F.struct(F.lit(path).alias("path"), f(layout).alias("content")) for path, f in fixed])


def addons(bundles: DataFrame, principles: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(bundle, path, content): an addon of each agent for each bundle; only its first five principles meet. (RND-11)"""
    place = F.row_number().over(Window.partitionBy("bundle").orderBy(F.col("ord").asc_nulls_last(), F.lower("title").asc_nulls_last(), F.col("id").asc_nulls_last()))
    first = principles.withColumn("_place", place).where("_place <= 5").drop("_place")
    return _exploded(bundled(bundles, first), [F.struct(F.lit(f".agent-context/prompt-addons/{a}.md").alias("path"), addon(a, layout).alias("content")) for a in AGENTS])


def _exploded(whole: DataFrame, made: list[Column]) -> DataFrame:
    return whole.select("bundle", F.explode(F.array(*made)).alias("d")).select("bundle", "d.*")


def documents(bundles: DataFrame, principles: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """(bundle, path, content): six documents of each bundle, one of each principle, and one addon of each agent. (RND-12)"""
    whole = bundled(bundles, principles)
    fixed = [("AGENTS.md", agents_root), (".claude/ethos/MEMORY.md", memory), (".agents/ethos/README.md", index)]
    each = _exploded(whole, [F.struct(F.lit(path).alias("path"), f(layout).alias("content")) for path, f in fixed])
    own = whole.select("bundle", "name", "repo", F.explode("principles").alias("p"))
    details = own.select("bundle", F.concat(F.lit(".agents/ethos/"), F.col("p.id"), F.lit(".md")).alias("path"), detail(F.col("p"), layout).alias("content"))
    return each.unionByName(ethos_documents(bundles, principles, layout)).unionByName(addons(bundles, principles, layout)).unionByName(details)


def topics_for(path: str, principles: Column, limit: int = 12) -> Column:
    """What a merge must keep in a root document: its own topics, then those of all principles, distinct, the first few.
    (SRT-03)"""
    return F.slice(F.array_distinct(F.concat(_array(*TOPICS.get(path, ())).cast("array<string>"), F.flatten(F.transform(principles, lambda p: p["merge_topics"])))), 1, limit)


def merges_existing(path: Column) -> Column:
    """Whether a document may stand in the repository already and is then merged. (FLT-15)"""
    return path.isin(*ROOTS)


def write_documents(documents: DataFrame, path: str) -> None:
    """(path, content) rows as JSON lines by Spark's writers, whose commit makes the write all or nothing. (SNK-01, SNK-04)"""
    documents.write.mode("overwrite").json(path)
