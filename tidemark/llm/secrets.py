"""Secret scan over a trigram inverted index.

Each rule's regular expression is analysed once into a Boolean query over trigrams that every match
must hold.  The inverted index has a posting (trigram, document) for each trigram that some query
names; intersecting the postings leaves each rule's candidate documents, and only their texts are
put to the expression itself.  A rule without mandatory trigrams scans every text.  Index, lookups
and verification are DataFrame expressions throughout.

Trigrams are taken from texts in lower case, which can only add candidates.  Matches are leftmost and
not overlapping for each kind; spans count code points and exclude their end.

Defined results: a null text counts as empty; rows that repeat, also with null ids, are scanned each;
an empty table gives no rows; columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, let

ADDED = ("found", "spans")


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0  # characters it must have
    base: bool = False


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base kinds in their order, then the added ones.
_NAMES = "|".join(_either_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
RULES = (
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abp]-[A-Za-z0-9-]{10,}"),
)

# A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | str | tuple


def _join(how: str, parts: list[Query]) -> Query:
    flat: set = set()
    for p in parts:
        if p is True:
            if how == "or":
                return True
        elif isinstance(p, tuple) and p[0] == how:
            flat |= p[1]
        else:
            flat.add(p)
    if how == "or":  # a clause that asks for more than another one adds nothing
        asks = {q: q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in flat}
        flat = {q for q in flat if not any(asks[o] < asks[q] for o in flat)}
    if not flat:
        return True
    return flat.pop() if len(flat) == 1 else (how, frozenset(flat))


def _demand(strings: set[str], most: int = 3) -> Query:
    """What holds if one of the strings is there: `most` trigrams of it, spread over its length, do."""

    def spread(s: str) -> list[str]:
        n = len(s) - 2
        return [s[i : i + 3] for i in range(n)] if n <= most else [s[i : i + 3] for i in sorted({(n - 1) * j // (most - 1) for j in range(most)})]

    return _join("or", [_join("and", spread(s)) for s in sorted(strings)])


def trigram_query(pattern: str, most: int = 24) -> Query:
    """The trigrams, in lower case, that any match of the pattern must hold."""
    import re._constants as k
    import re._parser as parser

    def walk(items) -> tuple[set[str] | None, Query]:
        """All strings that the items can match, if few; else None, and the demand."""
        known: set[str] = {""}
        demands: list[Query] = []
        open_ = False  # something unbounded came before, so `known` is not the whole
        for op, arg in items:
            part: set[str] | None
            demand: Query = True
            if op is k.LITERAL:
                part = {chr(arg).lower()}
            elif op is k.IN and all(o is k.LITERAL for o, _ in arg):
                part = {chr(c).lower() for _, c in arg}
            elif op is k.SUBPATTERN:
                part, demand = walk(arg[3])
            elif op is k.BRANCH:
                found = [walk(x) for x in arg[1]]
                part = set().union(*(f[0] for f in found)) if all(f[0] is not None for f in found) else None
                demand = True if part is not None else _join("or", [f[1] if f[0] is None else _demand(f[0]) for f in found])
            elif op is k.MAX_REPEAT and arg[1] == 1:
                inner, _ = walk(arg[2])
                part = None if inner is None else inner | ({""} if arg[0] == 0 else set())
            elif op is k.MAX_REPEAT and arg[0] == arg[1] and arg[1] <= 4:
                inner, demand = walk(arg[2])
                part = None if inner is None else {"".join(p) for p in product(sorted(inner), repeat=arg[1])}
            elif op is k.MAX_REPEAT and arg[0]:  # once at least, then no telling
                inner, demand = walk(arg[2])
                if inner is not None and len(inner) * len(known) <= most:
                    demands.append(_demand({a + b for a in known for b in inner}))
                    known, open_ = {""}, True
                    continue
                part = None
            elif op is k.AT:
                part = {""}
            else:
                part = None
            optional = part is not None and "" in part and min(map(len, known)) > 2
            if part is not None and not optional and len(part) * len(known) <= most:
                known = {a + b for a in known for b in part}
                continue
            demands += [_demand(known), demand if part is None or optional else _demand(part)]
            known, open_ = {""}, True
        if open_:
            return None, _join("and", [*demands, _demand(known)])
        return known, True

    strings, demand = walk(parser.parse(pattern))
    return demand if strings is None else _demand(strings)


def _trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def postings(docs: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """The inverted index: a row (trigram number, key) for each named trigram that a text holds."""
    held = let(F.lower(text), lambda folded: F.array_compact(F.array(*(F.when(F.contains(folded, F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)))))
    return docs.select(F.col(key).alias("key"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query], trigrams: list[str]) -> DataFrame:
    """Rows (key, a flag for each rule): its postings meet the rule's query."""
    at = {t: i for i, t in enumerate(trigrams)}
    words = range(len(trigrams) // 62 + 1)
    bit = F.expr("shiftleft(1L, cast(trigram % 62 as int))")
    held = index.groupBy("key").agg(*(F.bit_or(F.when(F.floor(F.col("trigram") / 62) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words))

    def holds(q: Query) -> Column:
        if isinstance(q, str):
            return F.col(f"m{at[q] // 62}").bitwiseAND(F.lit(1 << at[q] % 62).cast("long")) != 0
        return reduce(Column.__and__ if q[0] == "and" else Column.__or__, [holds(x) for x in sorted(q[1], key=str)])

    flags = held.select("key", *(holds(q).alias(k) for k, q in queries.items()))
    return flags.where(reduce(Column.__or__, [F.col(k) for k in queries]))


def _running(lengths: Column) -> Column:
    """Running sums of an array in about n * sqrt(n) steps."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    step = lambda a: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / step(a)).cast("int")), lambda j: total(F.slice(a, j * step(a) + 1, step(a))))

    def upto(a: Column, b: Column, i: Column) -> Column:
        whole = F.floor((i - 1) / step(a)).cast("int")
        return total(F.slice(b, F.lit(1), whole)) + total(F.slice(a, whole * step(a) + 1, (i - 1) % step(a) + 1))

    return let(lengths, lambda a: let(blocks(a), lambda b: F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: upto(a, b, i))))


_NONE = "array<struct<start:int,nth:int,end:int,kind:string>>"


def _spans(rule: Rule, nth: int, text: Column) -> Column:
    """The rule's matches in a text, as an array of (start, nth, end, kind)."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = whole if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.length(g) + F.length(m))
    made = F.zip_with(F.arrays_zip(_running(lengths).alias("end"), whole.alias("whole")), counted, lambda x, c: F.struct((x["end"] - F.length(x["whole"])).alias("start"), F.lit(nth).alias("nth"), x["end"].alias("end"), F.lit(rule.kind).alias("kind"), (F.length(c) >= rule.least).alias("long")))
    kept = F.transform(F.filter(made, lambda x: x["long"]), lambda x: F.struct(x["start"].alias("start"), x["nth"].alias("nth"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.when(F.size(whole) > 0, kept).otherwise(F.array().cast(_NONE))


def written_spans(found: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", small: int = 1_000_000) -> DataFrame:
    """docs with found (array of start, nth, end, kind by start, then rule) and spans (the same as a string).

    small: the candidates are broadcast if they are at most so many rows, about 16 MB; else joined by shuffle.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED))
    queries = {f"r{i}": q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    trigrams = sorted(set().union(*map(_trigrams, queries.values()))) if queries else []
    joined = docs
    if queries:
        marks = candidates(postings(docs, trigrams, key, text), queries, trigrams)
        from .shared import written

        marks = written(marks, "secret-candidates")
        own = free_name(docs, "candidate")
        renamed = marks.select(F.col("key").alias(own), *(F.col(k).alias(f"{own}{k}") for k in queries))
        if renamed.count() <= small:
            renamed = F.broadcast(renamed)
        joined = docs.join(renamed, F.col(key).eqNullSafe(F.col(own)), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    each = []
    for i, r in enumerate(rules):
        spans = _spans(r, i, body)
        each.append(F.when(F.col(f"{own}r{i}"), spans).otherwise(F.array().cast(_NONE)) if f"r{i}" in queries else spans)
    out = joined.withColumn("found", F.array_sort(F.concat(*each)))
    return out.select(*docs.columns, "found", written_spans(F.col("found")).alias("spans"))
