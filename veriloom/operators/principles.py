"""The principle model as DataFrames: items read from JSON, checked, completed with derived defaults, and overlaid.

A row is a principle: id, ord, title, summary, body, directive, sections (array of id, title, summary, body, kind),
quick_ref, merge_topics, tags, related (arrays of texts) and agent_hints (map). Presets are small lookup tables that the
caller gives as mappings; they become constant map expressions, so no step but the overlay joins anything.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as T
from veriloom.session import spread

# Agents, kinds of sections, and words of a heading that tell its kind, in order. (PRJ-03, PRJ-05, FN-05)
AGENTS = ("codex", "claude", "gemini")
KINDS = ("overview", "guidance", "rule", "policy", "workflow", "anti_patterns", "correct_way", "rationale", "examples", "reference", "repo_context")
KIND_WORDS = (
    (("overview", "summary", "core principle", "essence"), "overview"),
    (("why", "rationale", "reason", "motivation", "importance"), "rationale"),
    (("anti pattern", "anti patterns", "bad way", "wrong way", "what not to do", "not acceptable", "failure mode"), "anti_patterns"),
    (("right way", "correct way", "preferred way", "do this instead", "good way"), "correct_way"),
    (("rule", "rules", "policy", "practical rule", "non negotiable", "contract"), "rule"),
    (("workflow", "process", "procedure", "steps", "operational implication"), "workflow"),
    (("example", "examples"), "examples"),
    (("checklist", "quick ref", "reference"), "reference"),
    (("repo",), "repo_context"),
)
VERSION = 2

SECTION = "struct<id:string,title:string,summary:string,body:string,kind:string>"
ITEM = f"id string, `order` string, title string, summary string, body string, directive string, sections array<{SECTION}>, quick_ref string, merge_topics string, tags array<string>, related array<string>, agent_hints map<string,string>, prepend string, append string"


def _text(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), 0)


def _listing(mapping: dict) -> Column:
    """A mapping of texts, or of maps of texts, as a constant map."""
    kind = "map<string,map<string,string>>" if any(isinstance(v, dict) for v in mapping.values()) else "map<string,string>"
    return F.from_json(F.lit(json.dumps(mapping)), kind)


def lines(value: Column) -> Column:
    """A scalar, or a list as JSON, as trimmed texts without blank ones; none for null. (PRJ-01)"""
    listed = F.when(F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(T.normalized_list(F.filter(listed, lambda x: x.isNotNull())))


def commands(raw: Column) -> Column:
    """A map of scalars or lists, as JSON texts, as a map of lists. (PRJ-02)"""
    return F.transform_values(F.coalesce(raw, F.create_map().cast("map<string,string>")), lambda _, v: lines(v))


def agent_notes(raw: Column) -> Column:
    """The notes of each agent, all agents present unless raw has none. (PRJ-03)"""
    full = F.map_from_entries(F.array(*[F.struct(F.lit(a).alias("key"), lines(F.element_at(raw, a)).alias("value")) for a in AGENTS]))
    return F.when(F.coalesce(F.size(raw), F.lit(0)) > 0, full).otherwise(F.create_map().cast("map<string,array<string>>"))


def agent_hints(raw: Column) -> Column:
    """Trimmed hints of known agents, without blank ones. (PRJ-04)"""
    known = F.map_filter(F.coalesce(raw, F.create_map().cast("map<string,string>")), lambda a, v: a.isin(*AGENTS) & (_text(v) != ""))
    return F.transform_values(known, lambda _, v: F.trim(v))


def unknown_agents(raw: Column) -> Column:
    """Sorted keys of a map that name no agent. (PRJ-03, PRJ-04)"""
    return F.array_sort(F.array_except(F.coalesce(F.map_keys(raw), F.array().cast("array<string>")), F.array(*[F.lit(a) for a in AGENTS])))


def sections(raw: Column, body: Column, summary: Column) -> Column:
    """Sections with trimmed fields; without any, an inline body makes one overview. A missing summary is the first line of
    the body, a missing kind guidance. (PRJ-05)"""
    first = lambda b: F.trim(F.substring_index(b, "\n", 1))
    given = lambda s, b: F.when(_text(s) != "", _text(s)).otherwise(first(b))
    end = lambda b: F.regexp_replace(F.coalesce(b, F.lit("")), r"\s+\z", "")
    one = lambda s: F.struct(_text(s["id"]).alias("id"), _text(s["title"]).alias("title"), given(s["summary"], end(s["body"])).alias("summary"), end(s["body"]).alias("body"), F.coalesce(F.when(F.trim(s["kind"]) != "", F.trim(s["kind"])), F.lit("guidance")).alias("kind"))
    inline = F.array(F.struct(F.lit("overview").alias("id"), F.lit("Overview").alias("title"), given(summary, end(body)).alias("summary"), end(body).alias("body"), F.lit("overview").alias("kind")))
    none = F.array().cast(f"array<{SECTION}>")
    return F.when(F.coalesce(F.size(raw), F.lit(0)) > 0, F.transform(raw, one)).when(end(body) != "", inline).otherwise(none)


def quick_ref(summary: Column, directive: Column, section_summaries: Column, limit: int = 3) -> Column:
    """Directive, section summaries and summary, distinct and not blank, the first few. (SRT-02)"""
    return T.distinct_in_order(F.concat(F.array(directive), section_summaries, F.array(summary)), limit)


def merge_topics(title: Column, tags: Column, topics: dict[str, str] | None = None, limit: int = 3) -> Column:
    """The title as a phrase, then the topics of tags (or their phrases), distinct, the first few. (JOIN-18)"""
    phrase = lambda x: F.trim(F.regexp_replace(x, "[-_]+", " "))
    of = _listing(topics or {})
    return F.slice(F.array_distinct(F.concat(F.array(phrase(F.lower(title))), F.transform(tags, lambda t: F.coalesce(F.element_at(of, t), phrase(t))))), 1, limit)


def hints_of_tags(tags: Column, defaults: dict[str, str], of_tag: dict[str, dict[str, str]] | None = None) -> Column:
    """Each agent's hint: that of the last tag that has one for it, else its default. (JOIN-19)"""
    table = _listing(of_tag or {"": {"": ""}})
    last = lambda a: F.element_at(F.concat(F.array(F.lit(defaults.get(a, ""))), F.array_compact(F.transform(tags, lambda t: F.element_at(F.element_at(table, t), a)))), -1)
    return F.map_from_entries(F.array(*[F.struct(F.lit(a).alias("key"), last(a).alias("value")) for a in AGENTS]))


def principles(items: DataFrame, *, topics: dict[str, str] | None = None, default_hints: dict[str, str] | None = None, tag_hints: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Principles of items (source, payload: a JSON object), with `source`, and `errors`: what is wrong with each, in the
    order in which it is looked for. Missing directives are the summary, missing summaries that of the first section,
    missing short lists and hints are derived. (PRJ-06)"""
    raw = spread(items.select("source", "payload")).select("source", F.from_json("payload", ITEM).alias("p"))
    p = lambda c: F.col("p")[c]
    base = raw.select("source", "p", _text(p("id")).alias("id"), p("order").try_cast("int").alias("ord"), _text(p("title")).alias("title"), sections(p("sections"), p("body"), p("summary")).alias("sections"))
    base = base.withColumn("summary", F.when(_text(p("summary")) != "", _text(p("summary"))).otherwise(F.coalesce(F.get("sections", 0)["summary"], F.lit(""))))
    base = base.withColumns({"directive": F.trim(F.coalesce(p("directive"), F.col("summary"))), "tags": T.normalized_list(F.coalesce(p("tags"), F.array().cast("array<string>"))), "related": T.normalized_list(F.coalesce(p("related"), F.array().cast("array<string>")))})
    own = lambda given, derived: F.when(F.size(given) > 0, given).otherwise(derived)
    summaries = F.transform("sections", lambda s: s["summary"])
    done = base.withColumns(
        {
            "body": F.regexp_replace(F.array_join(F.transform("sections", lambda s: s["body"]), "\n\n"), r"\s+\z", ""),
            "quick_ref": own(lines(p("quick_ref")), quick_ref(F.col("summary"), F.col("directive"), summaries)),
            "merge_topics": own(lines(p("merge_topics")), merge_topics(F.col("title"), F.col("tags"), topics)),
            "agent_hints": own(agent_hints(p("agent_hints")), hints_of_tags(F.col("tags"), default_hints or {}, tag_hints)),
            "errors": item_errors(F.col("p"), F.col("id"), F.col("title"), F.col("ord"), F.col("sections"), F.col("directive")),
        }
    )
    return done.select("source", *COLUMNS, "errors")


COLUMNS = ("id", "ord", "title", "summary", "body", "directive", "sections", "quick_ref", "merge_topics", "tags", "related", "agent_hints")


def item_errors(p: Column, id_: Column, title: Column, ord_: Column, parts: Column, directive: Column) -> Column:
    """Messages about one item. (PRJ-01, PRJ-04 to PRJ-06)"""
    name = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    ids = F.transform(parts, lambda s: s["id"])
    twice = F.array_sort(F.array_distinct(F.filter(ids, lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1)))
    per_section = lambda bad, message: F.transform(F.filter(parts, bad), message)
    empty = lambda field: F.when(p[field].isNotNull() & (F.size(lines(p[field])) == 0), f"`{field}` must contain at least one non-empty string when provided.")
    agents = unknown_agents(p["agent_hints"])
    return F.concat(
        F.array_compact(
            F.array(
                F.when(id_ == "", "each principle must define a non-empty `id`."),
                F.when(title == "", F.concat(F.lit("principle "), name(id_), F.lit(" must define a non-empty `title`."))),
                F.when(ord_.isNull(), F.concat(F.lit("principle "), name(id_), F.lit(" must define an integer `order`."))),
            )
        ),
        per_section(lambda s: s["id"] == "", lambda s: F.lit("each section must define a non-empty `id`.")),
        F.transform(F.filter(twice, lambda x: x != ""), lambda x: F.concat(F.lit("duplicate section id "), name(x), F.lit("."))),
        per_section(lambda s: s["title"] == "", lambda s: F.concat(F.lit("section "), name(s["id"]), F.lit(" must define a non-empty `title`."))),
        per_section(lambda s: s["body"] == "", lambda s: F.concat(F.lit("section "), name(s["id"]), F.lit(" must define a non-empty `body`."))),
        per_section(lambda s: ~s["kind"].isin(*KINDS), lambda s: F.concat(F.lit("section "), name(s["id"]), F.lit(f" section kind must be one of: {', '.join(KINDS)}"))),
        F.array_compact(
            F.array(
                F.when(F.size(parts) == 0, F.concat(F.lit("principle "), name(id_), F.lit(" must include at least one section or inline `body`."))),
                F.when((F.size(parts) > 0) & (directive == ""), F.concat(F.lit("principle "), name(id_), F.lit(" must define a non-empty `directive`."))),
                empty("quick_ref"),
                empty("merge_topics"),
                F.when(F.size(agents) > 0, F.concat(F.lit("agent_hints contains unsupported agents: "), F.array_join(agents, ", "))),
            )
        ),
    )


def collection_errors(rows: DataFrame) -> DataFrame:
    """(kind, name, detail): ids and orders that occur more than once, and related ids that no row has. (JOIN-06)"""
    ids = rows.groupBy("id").count().where("count > 1").select(F.lit("duplicate id").alias("kind"), F.col("id").alias("name"), F.lit("").alias("detail"))
    orders = rows.groupBy("ord").count().where("count > 1").select(F.lit("duplicate order").alias("kind"), F.col("ord").cast("string").alias("name"), F.lit("").alias("detail"))
    wanted = rows.select("id", F.explode("related").alias("r"))
    lost = wanted.join(rows.select(F.col("id").alias("_k")).distinct(), F.col("r") == F.col("_k"), "left_anti").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("r")), ", ").alias("detail"))
    return ids.unionByName(orders).unionByName(lost.select(F.lit("unknown related").alias("kind"), F.col("id").alias("name"), "detail"))


def checked(rows: DataFrame) -> DataFrame:
    """rows without source and errors; raises the first error of an item, else of the collection."""
    first = rows.where(F.size("errors") > 0).orderBy("source").select("source", F.get("errors", 0).alias("e")).limit(1).collect()
    if first:
        raise ValueError(f"{first[0].source}: {first[0].e}")
    clash = collection_errors(rows).orderBy("kind", "name").limit(1).collect()
    if clash:
        raise ValueError(f"{clash[0].kind} `{clash[0]['name']}` {clash[0].detail}".strip())
    return rows.select(*COLUMNS)


def overlaid(base: DataFrame, overrides: DataFrame, *, topics: dict[str, str] | None = None, default_hints: dict[str, str] | None = None, tag_hints: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """base with overrides (id, payload: a JSON object). Fields that the payload has replace, a null too; prepend and append
    add sections; short lists and hints are derived anew if what they come from changed and the payload has none.
    (JOIN-03, JOIN-05)

    One left join on id; which fields are present is read from the payload's keys, so null isn't taken for absent.
    """
    o = overrides.select(F.col("id").alias("_id"), F.from_json("payload", ITEM).alias("o"), F.json_object_keys("payload").alias("_keys"))
    j = base.join(o, F.col("id") == F.col("_id"), "left")
    has = lambda c: F.coalesce(F.array_contains("_keys", c), F.lit(False))
    none = F.array().cast("array<string>")
    listed = lambda c: T.normalized_list(F.coalesce(F.col("o")[c], none))
    extra = lambda c, i, t: F.when(_text(F.col("o")[c]) == "", F.array().cast(f"array<{SECTION}>")).otherwise(F.array(F.struct(F.lit(i).alias("id"), F.lit(t).alias("title"), F.trim(F.substring_index(_text(F.col("o")[c]), "\n", 1)).alias("summary"), _text(F.col("o")[c]).alias("body"), F.lit("repo_context").alias("kind"))))
    new = j.withColumns(
        {
            "summary": F.when(has("summary"), _text(F.col("o.summary"))).otherwise(F.col("summary")),
            "directive": F.when(has("directive"), _text(F.col("o.directive"))).otherwise(F.col("directive")),
            "tags": F.when(has("tags"), listed("tags")).otherwise(F.col("tags")),
            "related": F.when(has("related"), listed("related")).otherwise(F.col("related")),
            "sections": F.concat(extra("prepend", "repo-preface", "Repo Preface"), "sections", extra("append", "repo-addendum", "Repo Addendum")),
        }
    )
    moved = has("summary") | has("directive") | (_text(F.col("o.prepend")) != "") | (_text(F.col("o.append")) != "")
    derived = hints_of_tags(F.col("tags"), default_hints or {}, tag_hints)
    given = agent_hints(F.col("o.agent_hints"))
    kept = F.map_filter(derived, lambda k, v: ~F.array_contains(F.map_keys(given), k))
    done = new.withColumns(
        {
            "body": F.when(F.col("_id").isNull(), F.col("body")).otherwise(F.regexp_replace(F.array_join(F.transform("sections", lambda s: s["body"]), "\n\n"), r"\s+\z", "")),
            "quick_ref": F.when(has("quick_ref"), lines(F.col("o.quick_ref"))).when(moved, quick_ref(F.col("summary"), F.col("directive"), F.transform("sections", lambda s: s["summary"]))).otherwise(F.col("quick_ref")),
            "merge_topics": F.when(has("merge_topics"), lines(F.col("o.merge_topics"))).when(has("tags"), merge_topics(F.col("title"), F.col("tags"), topics)).otherwise(F.col("merge_topics")),
            "agent_hints": F.when(has("agent_hints") & (F.size(given) > 0), F.map_concat(kept, given)).when(has("tags") & ~has("agent_hints"), derived).otherwise(F.col("agent_hints")),
        }
    )
    return done.select(*COLUMNS)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows by order, then by title in lower case. (SRT-01)"""
    return rows.orderBy("ord", F.lower("title"))


def profiles(given: DataFrame, defaults: dict[str, dict]) -> DataFrame:
    """(agent, root_file, supporting_files, notes) of each agent: the entry of given (agent, payload: JSON), or as a whole
    the default one. (PRJ-07)"""
    spark = given.sparkSession
    base = spark.createDataFrame([(a, json.dumps(defaults.get(a, {}))) for a in AGENTS], "agent string, _default string")
    raw = F.from_json(F.coalesce("payload", "_default"), "root_file string, supporting_files array<string>, notes string")
    j = base.join(given.select("agent", "payload"), "agent", "left").withColumn("r", raw)
    return j.select("agent", _text(F.col("r.root_file")).alias("root_file"), T.normalized_list(F.coalesce("r.supporting_files", F.array().cast("array<string>"))).alias("supporting_files"), lines(F.col("r.notes")).alias("notes"))


REPO = "name string, overview string, commands map<string,string>, paths map<string,string>, notes string"


def repo_context(payload: Column) -> Column:
    """The struct (name, overview, commands, paths, notes, agent_notes) of an overlay's JSON. (PRJ-08)"""
    top = F.from_json(payload, f"repo struct<{REPO.replace(' string', ':string').replace(' map', ':map').replace(', ', ',')}>, agent_notes map<string,string>")

    def of(t: Column) -> Column:
        r = t["repo"]
        paths = F.coalesce(r["paths"], F.create_map().cast("map<string,string>"))
        return F.struct(_text(r["name"]).alias("name"), _text(r["overview"]).alias("overview"), commands(r["commands"]).alias("commands"), paths.alias("paths"), lines(r["notes"]).alias("notes"), agent_notes(t["agent_notes"]).alias("agent_notes"))

    return _let(top, of)


def section_kind(title: Column) -> Column:
    """The kind of a section by the words of its heading; the first rule wins. (FN-05)"""
    return T.first_rule(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), list(KIND_WORDS), "guidance")


_ONE = r"(?md)^## \*\*(\d+)\.[ \t]*(.+?)\*\*$"
_SUB = r"(?md)^###\s+(?:\*\*)?(.+?)(?:\*\*)?\s*$"


def split_sections(body: Column) -> Column:
    """Sections of a body cut at third-level headings; what stands before the first is an overview, and so is a body
    without any. (WIN-03)"""

    def of(clean: Column) -> Column:
        parts = F.split(clean, _SUB, -1)
        titles = F.regexp_extract_all(clean, F.lit(_SUB), F.lit(1))
        intro = _bare(F.get(parts, 0))
        overview = lambda b: F.array(F.struct(F.lit("overview").alias("id"), F.lit("Overview").alias("title"), T.summarize(b).alias("summary"), b.alias("body"), F.lit("overview").alias("kind")))
        named = lambda t, b: F.struct(T.slugify(t).alias("id"), t.alias("title"), T.summarize(b).alias("summary"), T.without_rule(b).alias("body"), section_kind(t).alias("kind"))
        rest = F.zip_with(F.transform(titles, lambda t: F.trim(F.replace(t, F.lit("**"), F.lit("")))), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), named)
        return F.when(F.size(titles) == 0, overview(clean)).when(intro == "", rest).otherwise(F.concat(overview(intro), rest))

    return _let(T.without_rule(body), of)


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def seed(documents: DataFrame, *, title: str = "Ethos", presets: dict[str, dict] | None = None, topics: dict[str, str] | None = None, default_hints: dict[str, str] | None = None, tag_hints: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(path, doc_title, overview, and a principle's columns) of Markdown documents (path, text): one row for each heading
    of the form '## **n. Title**', documents without one give none. (SRC-17, SNK-02, SET-02)

    title: that of documents without a main heading. presets: directive, tags and related ids by id. Headings and the texts behind them come from one split, so a document
    is read once, and documents are independent rows.
    """
    presets = presets or {}
    part = lambda field: _listing({k: json.dumps(v[field]) for k, v in presets.items() if field in v} or {"": ""})
    listed = lambda field: F.coalesce(F.from_json(F.element_at(part(field), F.col("id")), "array<string>"), F.array().cast("array<string>"))
    main = F.regexp_extract("text", r"(?md)^#\s+\*\*(.+?)\*\*$", 1)
    before = F.when(F.contains("text", F.lit("## Table of Contents")), F.substring_index("text", "## Table of Contents", 1)).otherwise("")
    overview = T.without_rule(F.when(main == "", before).otherwise(F.element_at(F.split(before, r"(?md)^#\s+\*\*.+?\*\*$", 2), -1)))
    cut = F.split("text", _ONE, -1)
    heads = F.zip_with(F.regexp_extract_all("text", F.lit(_ONE), F.lit(1)), F.regexp_extract_all("text", F.lit(_ONE), F.lit(2)), lambda n, t: F.struct(n.alias("n"), F.trim(t).alias("title")))
    pairs = F.zip_with(heads, F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1))), lambda h, b: F.struct(h["n"].cast("int").alias("ord"), h["title"].alias("title"), T.without_rule(b).alias("text")))
    rows = documents.select("path", F.when(main == "", title).otherwise(main).alias("doc_title"), overview.alias("overview"), F.explode(pairs).alias("h")).where(~F.lower("h.title").isin("table of contents", "in summary"))
    rows = rows.select("path", "doc_title", "overview", T.slugify(F.col("h.title")).alias("id"), "h.ord", "h.title", T.summarize(F.col("h.text")).alias("summary"), F.col("h.text").alias("raw"), split_sections(F.col("h.text")).alias("sections"))
    directive = F.coalesce(F.from_json(F.concat(F.lit("["), F.element_at(part("directive"), F.col("id")), F.lit("]")), "array<string>")[0], F.col("summary"))
    found = F.regexp_extract_all("raw", F.lit(r"\(#\d+-([a-z0-9-]+)\)"), F.lit(1))
    rows = rows.withColumns({"directive": directive, "tags": listed("tags"), "related": F.array_sort(F.array_distinct(F.filter(F.concat(listed("related"), found), lambda x: x != F.col("id"))))})
    rows = rows.withColumns(
        {
            "body": F.array_join(F.transform("sections", lambda s: s["body"]), "\n\n"),
            "quick_ref": quick_ref(F.col("summary"), F.col("directive"), F.transform("sections", lambda s: s["summary"])),
            "merge_topics": merge_topics(F.col("title"), F.col("tags"), topics),
            "agent_hints": hints_of_tags(F.col("tags"), default_hints or {}, tag_hints),
        }
    )
    return rows.select("path", "doc_title", "overview", *COLUMNS)
