"""Secret scans through a trigram inverted index, in DataFrame expressions only.

Each rule's regex gives a Boolean trigram query: alternatives of strings, one of which every match holds, each a
conjunction of its trigrams. The index holds the postings of the queries' trigrams: (block, trigram, keys of the texts that
hold it), texts being dealt to blocks of bounded size by their hash. For each rule and block, postings are intersected
within a conjunction and united over the alternatives; the texts found are the candidates, and only these are fetched and
verified with the rule's regex, once each however many rows have them. Rules without mandatory trigrams scan all texts
where they are read. A hash that two texts share can add candidates, which are verified, but never loses one.

Matches are taken leftmost and non-overlapping by the regex engine; their places are running sums over the lengths of the
matches and of the pieces between them, taken in slices, so that work stays in proportion to the matches. No rule follows
a start for more than a bounded length without consuming what it followed, so near matches don't add up either.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.names import free
from veriloom.session import ready, staged, unstage


@dataclass(frozen=True)
class Rule:
    """kind; regex (as Java's engine reads it); least length of a group for a match to stay; whether letters of the
    mandatory literals match in either case."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    any_case: bool = False


ASSIGN = Rule("assign", r"((?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True)
ACCESS = Rule("access", "AKIA[A-Z0-9]+", 0, 16)
HEX = Rule("hex", "[0-9a-f]{32,}", 0, 32)
BASE = (ASSIGN, ACCESS, HEX)
#: Further public token formats.
EXTRA = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    # a header of bounded length: else each of many starts in one run without a dot would be followed to the run's end
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,400}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = (*BASE, *EXTRA)
#: Texts of a block of the index (about), items of a slice of an array, characters of a piece of a text.
BLOCK, SLICE, PIECE = 8192, 256, 1024


def _strip(tree) -> list:
    out = []
    for op, value in tree:
        if str(op) == "SUBPATTERN":
            out += _strip(value[3])
        else:
            out.append((op, value))
    return out


def _exact(tree, most: int = 64) -> list[str] | None:
    """The strings that tree can match, if they are few."""
    found = [""]
    for op, value in _strip(tree):
        name = str(op)
        if name == "LITERAL":
            options = [chr(value)]
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in value):
            options = [chr(c) for o, v in value for c in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))]
        elif name == "BRANCH":
            parts = [_exact(x, most) for x in value[1]]
            if any(p is None for p in parts):
                return None
            options = [s for p in parts for s in p]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 4:
            part = _exact(value[2], most)
            if part is None:
                return None
            options, power = [], [""]
            for k in range(value[1] + 1):
                options += power if k >= value[0] else []
                power = [a + b for a in power for b in part]
                if len(power) > most:
                    return None
        else:
            return None
        found = [a + b for a in found for b in options]
        if len(found) > most:
            return None
    return list(dict.fromkeys(found))


def trigram_query(rule: Rule) -> list[list[str]] | None:
    """The Boolean query of a rule in disjunctive form: trigrams that occur together in every match; None if there are none.

    Runs of the regex with few exact strings are candidates; the one whose shortest string is longest wins, then the one
    with the fewest strings. Conjunctions that hold another one are left out.
    """
    from re import _parser  # the standard library's own reading of a regex

    tree = _strip(_parser.parse(rule.regex.replace("(?i)", "")))
    runs: list[list[str]] = []
    for a in range(len(tree)):
        for z in range(a + 1, len(tree) + 1):
            got = _exact(tree[a:z])
            if got is None:
                break
            runs.append(got)
        if str(tree[a][0]) in ("MAX_REPEAT", "MIN_REPEAT") and tree[a][1][0] >= 1:
            got = _exact(tree[a][1][2])
            if got:
                runs.append(got)
    runs = [r for r in runs if min(map(len, r)) >= 3]
    if not runs:
        return None
    best = max(runs, key=lambda r: (min(map(len, r)), -len(r)))
    fold = str.lower if rule.any_case else str
    query = [list(dict.fromkeys(fold(s)[i : i + 3] for i in range(len(s) - 2))) for s in best]
    return [q for i, q in enumerate(query) if not any(set(o) < set(q) or set(o) == set(q) and j < i for j, o in enumerate(query))]


def dictionary(rules: tuple[Rule, ...]) -> dict[tuple[str, bool], int]:
    """The trigrams of the rules' queries, each with its bit; True where they are looked up in lower case."""
    keys: dict[tuple[str, bool], int] = {}
    for rule in rules:
        for conjunction in trigram_query(rule) or []:
            for t in conjunction:
                keys.setdefault((t, rule.any_case), len(keys))
    return keys


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(items: Column, add: Callable, join: Callable, emit: Callable, kind: str) -> Column:
    """emit(sum before an item, item) of each item of an array, as array<kind>. Sums are longs from 0: add(sum, item) adds
    an item, join(sum, sum) a slice's sum. Slices keep what is copied on appending small."""
    zero, none = F.lit(0).cast("bigint"), F.array().cast(f"array<{kind}>")

    def sums(slices: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, x: F.struct(join(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        return F.aggregate(F.transform(slices, lambda s: F.aggregate(s, zero, add)), start, step, lambda a: a["out"])

    def within(part: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), none.alias("out"))
        step = lambda a, x: F.struct(add(a["at"], x).alias("at"), F.array_append(a["out"], emit(a["at"], x).cast(kind)).alias("out"))
        return F.aggregate(part, start, step, lambda a: a["out"])

    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / SLICE).cast("int")), lambda b: F.slice(x, b * SLICE + 1, SLICE))
    whole = lambda x: F.when(F.size(x) == 0, none).otherwise(_let(cut(x), lambda slices: F.flatten(F.zip_with(slices, sums(slices), within))))
    return _let(items, whole)


_SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def _no_spans() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of one rule: places from the lengths of matches and of the pieces before them."""
    size = lambda x: F.coalesce(F.char_length(x), F.lit(0)).cast("bigint")
    all_of = lambda group: F.regexp_extract_all(text, F.lit(rule.regex), F.lit(group))
    lengths = F.zip_with(F.split(text, rule.regex, -1), all_of(0), lambda gap, m: F.struct(size(gap).alias("gap"), size(m).alias("n"), size(m).alias("g")))
    if rule.group:
        lengths = F.zip_with(lengths, all_of(rule.group), lambda x, g: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), size(g).alias("g")))
    add = lambda at, x: at + x["gap"] + x["n"]
    emit = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.when(x["g"] >= rule.least, rank).alias("rank"), F.lit(rule.kind).alias("kind"), (at + x["gap"] + x["n"]).alias("end"))
    return F.filter(_running(lengths, add, lambda a, b: a + b, emit, _SPAN), lambda s: s["rank"].isNotNull())


def index(texts: DataFrame, rules: tuple[Rule, ...], rows: int) -> DataFrame:
    """(block, trigram, keys): the postings of the rules' trigrams over texts (key, text); trigrams by their number in
    dictionary(rules). rows: how many texts there are, about."""
    # lower case of other alphabets may add postings, and with them candidates, but never loses one
    held = [F.when(F.contains(F.col("folded" if low else "text"), F.lit(t)), F.lit(k)) for (t, low), k in dictionary(rules).items()]
    found = texts.select("key", "text", F.lower("text").alias("folded")).select("key", F.explode(F.array_compact(F.array(*held))).alias("trigram"))
    return found.groupBy(F.pmod("key", F.lit(max(1, -(-rows // BLOCK)))).alias("block"), "trigram").agg(F.collect_set("key").alias("keys"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): texts that satisfy the trigram queries of rules, by rank, from index()."""
    keys = dictionary(rules)
    asked = [(rank, [[keys[t, r.any_case] for t in both] for both in trigram_query(r) or []]) for rank, r in enumerate(rules)]
    queries = F.expr("array(" + ", ".join(f"named_struct('rank', {rank}, 'any', cast(array({', '.join(f'array({", ".join(map(str, both))})' for both in any_of)}) as array<array<int>>))" for rank, any_of in asked) + ")")
    of = lambda t: F.coalesce(F.try_element_at("lists", t), F.array().cast("array<bigint>"))
    every = lambda both: F.aggregate(F.slice(both, 2, F.size(both)), of(F.get(both, 0)), lambda a, t: F.array_intersect(a, of(t)))
    found = F.transform(queries, lambda q: F.struct(q["rank"].alias("rank"), F.flatten(F.transform(q["any"], every)).alias("keys")))
    blocks = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    listed = blocks.select(F.explode(found).alias("f")).select("f.rank", F.explode("f.keys").alias("key"))
    return listed.groupBy("key").agg(F.collect_set("rank").alias("rules"))


def scan(docs: DataFrame, text_col: str = "text", *, rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """docs with `out`: array of (start, rank, kind, end), by start, then by the order of rules.

    Places are code points of the whole text, ends exclusive. Null and empty texts have an empty array; equal texts get
    equal arrays. Texts may be of any length and hold any number of matches. A column named like `out` is replaced; all
    others, and repeated rows, stay, whatever their names. An empty table stays empty.

    docs is read four times: to count it, for the index, for the candidates, and for the result. The spans found are a
    table in the shared folder, which the result reads; the other tables are deleted before this returns.
    """
    spark = ready(docs.sparkSession)
    k, h, more = free(docs, "key", "hash", "found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("key"), F.hash(text).alias("hash"), text.alias("text"))
    postings, at = staged(index(texts, rules, docs.count()), "trigrams")
    chosen, at_chosen = staged(candidates(postings, rules), "candidates")
    once = texts.join(chosen, "key").groupBy("key", "hash").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
    indexed = [F.when(F.array_contains("rules", k), _spans(r, k, F.col("text"))).otherwise(_no_spans()) for k, r in enumerate(rules) if trigram_query(r) is not None]
    verified = once.select(F.col("key").alias(k), F.col("hash").alias(h), F.concat(*indexed, _no_spans()).alias(more)).where(F.size(more) > 0)
    found, _ = staged(verified, "secrets")
    unstage(spark, at, at_chosen)
    scanned = [F.when(F.regexp_like(text, F.lit(r.regex)), _spans(r, k, text)).otherwise(_no_spans()) for k, r in enumerate(rules) if trigram_query(r) is None]
    keyed = docs.withColumns({k: F.xxhash64(text), h: F.hash(text), out: F.concat(*scanned, _no_spans())})
    joined = keyed.join(found, [k, h], "left")
    return joined.withColumn(out, F.array_sort(F.concat(out, F.coalesce(more, _no_spans())))).drop(k, h, more)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters from start to end of a text that lies in pieces of PIECE characters."""
    first = F.floor(start / PIECE)
    part = F.array_join(F.slice(pieces, (first + 1).cast("int"), (F.floor((end - 1) / PIECE) - first + 1).cast("int")), "")
    return F.when(end > start, F.substring(part, (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with each secret replaced by [kind]; columns as before, null texts stay null. Overlapping spans merge, under
    the kind of the first. For the other cases see scan()."""
    (out,) = free(docs, "secrets")
    kind = "struct<`from`:bigint,start:bigint,kind:string>"
    emit = lambda at, s: F.struct(at.alias("from"), s["start"].alias("start"), s["kind"].alias("kind"))

    def cut(pieces: Column) -> Column:
        # a span that begins before an earlier one's end goes with it
        steps = _running(F.col(out), lambda at, s: F.greatest(at, s["end"]), lambda a, b: F.greatest(a, b), emit, kind)
        heads = F.transform(F.filter(steps, lambda s: s["start"] >= s["from"]), lambda s: F.concat(_cut(pieces, s["from"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(heads, ""), _cut(pieces, F.array_max(F.transform(out, lambda s: s["end"])), F.char_length(text_col).cast("bigint")))

    found = scan(docs, text_col, out=out, **options)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return found.withColumn(text_col, F.when(F.size(out) == 0, F.col(text_col)).otherwise(_let(pieces, cut))).select(*docs.columns)
