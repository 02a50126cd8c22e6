"""Secret scanning through a trigram inverted index, in DataFrame functions only.

Every rule is a regular expression.  From its syntax tree follows a Boolean condition on trigrams that any text with a
match must meet: alternatives give OR, sequences AND, literal sets are joined across neighbours before they are cut
into trigrams, and whatever is not literal gives nothing.  The trigrams of all rules (some dozens) are looked up in each
lower-cased text, the postings (trigram -> sorted doc_ids, in shards of about `SHARD_DOCS` documents, so that no list grows with the table)
are written as the index, a rule's condition is evaluated by intersecting and uniting postings, and the candidates are
verified with the expression itself.  Rules without a mandatory trigram (bare hexadecimal runs) scan all texts.

Positions come from the engine's own splitting: the pieces between the matches and the matches alternate, so their
lengths add up to code point offsets of leftmost, non-overlapping matches.

Base rules, stated as the contract has them (greedy, then dropped when too short):
assign = keyword, separator, value of 6 or more; access = AKIA and 16 or more; hex = 24 or more of 0-9a-f.  For the
last two a run is maximal either way, so the bound stands in the expression.  `assign` needs the drop: a short value
still consumes its text.

Cases: a null text is empty and has no spans; an empty table gives no rows; rows that share an id, and rows
without one, are scanned each on its own, under a row key (row_keyed); extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import ROW, Workspace, broadcast_if_small, row_keyed

try:
    from re import _constants as sre, _parser as sre_parser
except ImportError:  # Python 3.10
    import sre_constants as sre
    import sre_parse as sre_parser

#: Documents a shard of the postings has on average, and with that the longest list of a trigram.
SHARD_DOCS = 20_000
MOST_LITERALS = 64
Condition = tuple[frozenset[str], ...]
TRUE: Condition = (frozenset(),)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # this group must have `least` characters, else the match is dropped
    least: int = 0


#: Fixed patterns.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds of credentials with a published prefix.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE + MORE


# --- trigram conditions: a tuple of alternatives, each a frozenset of trigrams that must all be there ---


def _least(parts) -> Condition:
    """Without alternatives that another one already implies; in a fixed order."""
    parts = set(parts)
    return tuple(sorted((p for p in parts if not any(q < p for q in parts)), key=sorted))


def both(a: Condition, b: Condition) -> Condition:
    """a and b; where that would have too many alternatives, a alone, which any match meets too."""
    return _least(x | y for x in a for y in b) if len(a) * len(b) <= MOST_LITERALS else a


def of_literals(words) -> Condition:
    """Any of these strings, lower case."""
    return _least(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words)


def _analyse(tree) -> tuple[set[str] | None, Condition]:
    """(all strings it can match, if few; else None, and then the condition) of a parsed expression."""
    run: set[str] | None = {""}
    need = TRUE
    exact = True
    for op, arg in tree:
        words, cond = _item(op, arg)
        if words is not None and len(words) * len(run) <= MOST_LITERALS:
            run = {a + b for a in run for b in words}
            continue
        exact = False
        need = both(need, of_literals(run))
        run = words if words is not None else {""}
        need = both(need, cond)
    return (run, TRUE) if exact else (None, both(need, of_literals(run)))


def _item(op, arg) -> tuple[set[str] | None, Condition]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, TRUE
    if op is sre.IN and not any(o is sre.NEGATE for o, _ in arg):
        chars: set[str] = set()
        for o, a in arg:
            if o is sre.LITERAL:
                chars.add(chr(a).lower())
            elif o is sre.RANGE and a[1] - a[0] < 8:
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None, TRUE
        return (chars, TRUE) if len(chars) <= 8 else (None, TRUE)
    if op is sre.SUBPATTERN:
        return _analyse(arg[-1])
    if op is sre.BRANCH:
        parts = [_analyse(t) for t in arg[1]]
        if all(w is not None for w, _ in parts):
            return set().union(*(w for w, _ in parts)), TRUE
        return None, _least(x for w, c in parts for x in (c if w is None else of_literals(w)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        words, cond = _analyse(inner)
        if words is not None and low == high == 1:
            return words, TRUE
        if words is not None and low == 0 and high == 1:
            return words | {""}, TRUE
        if low == 0:
            return None, TRUE
        return None, cond if words is None else of_literals(words)
    if op is sre.AT:
        return {""}, TRUE
    return None, TRUE


def trigram_condition(pattern: str) -> Condition:
    words, cond = _analyse(sre_parser.parse(pattern))
    return cond if words is None else of_literals(words)


# --- index ---


def build_index(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings: (shard, trigram, ids sorted) of the given trigrams."""
    grams = F.array(*[F.lit(t) for t in sorted(trigrams)])
    found = F.transform(F.array(F.lower(F.col(text))), lambda t: F.filter(grams, lambda g: F.contains(t, g)))[0]  # lower-cased once
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.explode(found).alias("trigram"))
    shard = F.pmod(F.xxhash64("id"), F.lit(docs.count() // SHARD_DOCS + 1)).cast("int")
    return rows.groupBy(shard.alias("shard"), "trigram").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(id, kinds): which of the rules (all with a trigram condition) a document may match; by intersecting postings shard by shard."""
    by_shard = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("p"))
    kind = index.schema["ids"].dataType.simpleString()
    none = F.array().cast(kind)

    def ids(cond: Condition) -> Column:
        every = [reduce(F.array_intersect, [F.coalesce(F.try_element_at("p", F.lit(t)), none) for t in sorted(p)]) for p in cond]
        return reduce(F.array_union, every)

    def tagged(found: Column, kind: str) -> Column:
        return F.transform(found, lambda i: F.struct(i.alias("id"), F.lit(kind).alias("kind")))

    per_rule = [tagged(ids(trigram_condition(r.pattern)), r.kind) for r in rules]
    return by_shard.select(F.inline(F.flatten(F.array(*per_rule)))).groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


# --- verification ---


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named (also inside of lambdas)."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an int array (>= 0) what those before it combine to, from 0: in blocks of the root of its size, so no long list is copied a step."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def scan(items: Column, total: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, start, lambda s, x: F.struct(combine(s["at"], total(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def by_blocks(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), width), lambda low: scan(F.slice(v, low + 1, width), lambda x: x))
        return bound(blocks, lambda b: F.flatten(F.zip_with(b, scan(b, lambda x: x["at"])["out"], lambda x, at: F.transform(x["out"], lambda y: combine(at, y)))))

    return bound(values, by_blocks)


def spans_of(text: Column, rule: Rule) -> Column:
    """Kept matches of a rule in `text` as array<struct<kind, start, end>>, code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m)) if rule.group else whole
    kind, least = rule.kind, rule.least

    def placed(steps: Column) -> Column:
        passed = running(F.transform(steps, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))), lambda a, b: a + b)
        every = F.zip_with(steps, passed, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("size")))
        kept = F.filter(every, lambda m: (m["size"] >= least) & (m["end"] > m["start"]))
        return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return bound(F.arrays_zip(gaps.alias("gap"), whole.alias("size"), value.alias("value")), placed)


def scan(docs: DataFrame, space: Workspace, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and spans (array<struct<kind, start, end>> by start, then rule order) of every row, whether or not `key` is there and unique."""
    docs = row_keyed(docs, space, key, text)
    conditions = {r.kind: trigram_condition(r.pattern) for r in rules}
    indexed = [r for r in rules if conditions[r.kind] != TRUE]
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    body = F.coalesce(F.col(text), F.lit(""))
    full = [F.when(body.rlike(r.pattern), spans_of(body, r)).otherwise(empty) for r in rules if conditions[r.kind] == TRUE]
    everywhere = docs.select(F.col(ROW).alias("id"), F.col(key).alias("key"), F.concat(empty, *full).alias("own"))
    if not indexed:
        joined = everywhere.select("key", F.col("own").alias("spans"))
    else:
        index = space.write(build_index(docs, sorted({t for r in indexed for p in conditions[r.kind] for t in p}), ROW, text), "index")
        some = space.write(candidates(index, indexed), "candidates")
        texts = docs.select(F.col(ROW).alias("id"), body.alias("body")).join(broadcast_if_small(some), "id")
        verified = texts.select("id", F.concat(*[F.when(F.array_contains("kinds", r.kind), spans_of(F.col("body"), r)).otherwise(empty) for r in indexed]).alias("more")).where(F.size("more") > 0)
        verified = space.write(verified.groupBy("id").agg(F.flatten(F.collect_list("more")).alias("more")), "verified")
        space.drop("index", "candidates")
        joined = everywhere.join(verified, "id", "left").select("key", F.concat("own", F.coalesce("more", empty)).alias("spans"))
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    sorted_spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(F.col("key").alias(key), sorted_spans.alias("spans"))


def of_kinds(spans: str, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with the union of the spans (sorted by start) replaced by the mark; pieces are cut from four bytes a code point, each at its place."""
    order_mark = F.unhex(F.lit("0000FEFF"))

    def cut(z: Column) -> Column:
        piece = lambda start, size: F.decode(F.concat(order_mark, F.substring(z["wide"], start * 4 + 1, size * 4)), "UTF-32")
        before = running(F.transform(z["spans"], lambda x: x["end"]), F.greatest)
        met = F.zip_with(z["spans"], before, lambda x, at: F.struct(at.alias("at"), x["start"].alias("start")))
        fresh = F.filter(met, lambda x: x["start"] >= x["at"])
        last = F.coalesce(F.array_max(F.transform(z["spans"], lambda x: x["end"])), F.lit(0))
        tail = piece(last, F.length(z["wide"]))
        return F.array_join(F.concat(F.transform(fresh, lambda x: piece(x["at"], x["start"] - x["at"])), F.array(tail)), mark)

    return bound(F.struct(F.encode(text, "UTF-32").alias("wide"), spans.alias("spans")), cut)
