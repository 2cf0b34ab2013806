"""Secret scan over a trigram inverted index, with built-in expressions only.

From each rule's pattern follows what a text must hold to match it: a Boolean query over trigrams, an OR of ANDs
(``trigram_query``). The index has a posting (trigram, row key) for each trigram that some query names and each text that
holds it, in either case of A-Z. The postings of a row meet by its key and are intersected as bits; a rule's candidates
are the rows whose bits answer its query, and only these are searched with its pattern. Rules without mandatory trigrams
(a run of hex digits) search every text. Row keys are hashes: texts that share one share candidates, which costs a search
and changes no result, since each match is verified on the text itself.

Offsets are code points, end exclusive. Matches are found left to right and do not overlap within a rule; those that fail
its least sizes are dropped without another try. Null texts are empty and have no spans. Rows are independent: repeated
rows and ids, null ids and ties change nothing; the caller's columns travel in one struct, so that their names can't clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from re import _constants as code
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import let, materialize, scan


@dataclass(frozen=True)
class Rule:
    """``group`` of a match has ``least`` characters or more."""

    pattern: str
    least: int = 0
    group: int = 0


# fixed values: the base rules, in the order of report
BASE = {
    "assign": Rule(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": Rule(r"AKIA[A-Z0-9]{16,}"),
    "hex": Rule(r"(?<![0-9a-f])[0-9a-f]{24,}"),
}
# fixed values: public formats of credentials
MORE = {
    "github": Rule(r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{36,255}(?![A-Za-z0-9_])"),
    "slack": Rule(r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,250}(?![A-Za-z0-9-])"),
    "google": Rule(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    "stripe": Rule(r"(?<![A-Za-z0-9_])[rs]k_(?:live|test)_[A-Za-z0-9]{16,250}(?![A-Za-z0-9_])"),
    "jwt": Rule(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "bearer": Rule(r"(?i:bearer)\x20[A-Za-z0-9+/_.=-]{20,}"),
    "url": Rule(r"""://[^\x00-\x20:/@"'<>]{1,64}:[^\x00-\x20:/@"'<>]{3,128}@[A-Za-z0-9]"""),
    "private": Rule(r"-----BEGIN (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\x09-\x0D]{1,100000}-----END (?:[A-Z]{2,10} ){0,3}PRIVATE KEY-----)?"),
}
RULES: dict[str, Rule] = BASE | MORE

#: Stands for characters that a pattern leaves open.
OPEN = "\0"
#: A class of at most so many letters is spelt out; a pattern is followed through at most so many ways.
SPELT, WAYS = 8, 128
BITS = 62


def _spelt(node) -> list[str]:
    """Members of a class as lower-case strings, or OPEN."""
    found: set[str] = set()
    for op, arg in node:
        if op is code.LITERAL:
            found.add(chr(arg).lower())
        elif op is code.RANGE and arg[1] - arg[0] < 2 * SPELT:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return [OPEN]
    return sorted(found) if len(found) <= SPELT else [OPEN]


def _ways(nodes) -> list[str]:
    """The strings that a match can be, in lower case, with OPEN where anything may stand."""
    out = [""]
    for op, arg in nodes:
        if op is code.LITERAL:
            more = [chr(arg).lower()]
        elif op is code.IN:
            more = _spelt(arg)
        elif op is code.BRANCH:
            more = [w for branch in arg[1] for w in _ways(branch)]
        elif op is code.SUBPATTERN:
            more = _ways(arg[3])
        elif op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = _ways(inner)
            more = ["", *one] if (low, high) == (0, 1) else [OPEN] if low == 0 else one if high == 1 else [w + OPEN for w in one]
        elif op in (code.AT, code.ASSERT, code.ASSERT_NOT):
            more = [""]
        else:
            more = [OPEN]
        if len(more) * len(out) > WAYS:
            more = [OPEN]
        out = list(dict.fromkeys(a + b for a, b in itertools.product(out, more)))
    return out


def trigram_query(pattern: str) -> list[list[str]]:
    """The trigrams that a text must hold to match ``pattern``: all of one of the lists. Without mandatory ones: [].

    Only what the pattern spells out in a row counts; lists that hold all of another one are left out.
    """
    sets = []
    for way in _ways(parser.parse(pattern)):
        pieces = way.split(OPEN)
        sets.append(frozenset(p[i : i + 3] for p in pieces for i in range(len(p) - 2)))
    if not all(sets):
        return []
    return sorted(sorted(s)[:BITS] for s in set(sets) if not any(t < s for t in sets))


def vocabulary(rules: Mapping[str, Rule]) -> list[str]:
    """All trigrams that the queries of ``rules`` name."""
    return sorted({t for r in rules.values() for ts in trigram_query(r.pattern) for t in ts})


def _key(row_id: Column, text: Column) -> Column:
    return F.xxhash64(row_id.cast("string"), text)


def postings(docs: DataFrame, grams: list[str], row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(gram, key) for each of ``grams`` that a text holds; ``gram`` is its place in the list."""
    held = let(F.lower(F.coalesce(F.col(text), F.lit(""))), lambda t: F.filter(F.array(*[F.when(F.contains(t, F.lit(g)), i) for i, g in enumerate(grams)]), lambda i: i.isNotNull()))
    return docs.select(_key(F.col(row_id), F.col(text)).alias("key"), F.explode(held).alias("gram")).select("gram", "key")


def build_index(docs: DataFrame, grams: list[str], row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``postings`` as a table in the shared folder, ordered by trigram in each file, so that a query skips the others."""
    return materialize(postings(docs, grams, row_id, text).sortWithinPartitions("gram", "key"))


def candidates(index: DataFrame, grams: list[str], rules: Mapping[str, Rule]) -> DataFrame:
    """(key, rules): the rules whose query the postings of a key answer. One shuffle of the postings, pre-aggregated."""
    place = {g: i for i, g in enumerate(grams)}
    queries = {name: q for name, r in rules.items() if (q := trigram_query(r.pattern))}
    used = sorted({place[g] for q in queries.values() for ts in q for g in ts})
    words = sorted({i // BITS for i in used})
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("gram") % BITS).cast("int"))
    masks = index.where(F.col("gram").isin(used)).groupBy("key").agg(*[F.bit_or(F.when(F.floor(F.col("gram") / BITS) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{w}") for w in words])

    def holds(ts: list[str]) -> Column:
        need = {w: sum(1 << place[t] % BITS for t in ts if place[t] // BITS == w) for w in words}
        return reduce(Column.__and__, [F.col(f"m{w}").bitwiseAND(F.lit(n)) == F.lit(n) for w, n in need.items() if n])

    answered = [F.when(reduce(Column.__or__, [holds(ts) for ts in q]), F.lit(name)) for name, q in queries.items()]
    found = masks.select("key", F.filter(F.array(*answered), lambda r: r.isNotNull()).alias("rules"))
    return found.where(F.size("rules") > 0)


SPAN = "struct<start:int,end:int,m:string>"


def matches(rule: Rule, text: Column) -> Column:
    """array<struct<start, end, m>> of the rule's matches; what lies between matches gives their places."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["gap"])
        end = begin + F.length(x["m"])
        return end, F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m")).cast(SPAN))

    def places(ms: Column) -> Column:
        pairs = F.zip_with(F.split(text, rule.pattern, -1), ms, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        return F.when(F.size(ms) == 0, none).otherwise(scan(F.filter(pairs, lambda x: x["m"].isNotNull()), F.lit(0), "int", SPAN, step))

    found = let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), places)
    return found if not rule.least else F.filter(found, lambda s: F.length(F.regexp_extract(s["m"], rule.pattern, rule.group)) >= rule.least)


def find(docs: DataFrame, rules: Mapping[str, Rule] = RULES, row_id: str = "doc_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """``row`` (a struct of the caller's columns) and ``spans``: array<struct<start, place, end, kind>> in order of start,
    then of the rules (``place``). ``index``: ``build_index``'s table for the ``vocabulary`` of these rules, if at hand.

    Texts are shuffled once, to meet their candidates; a key that many rows share is split by AQE, since it has one
    candidate row.
    """
    grams = vocabulary(rules)
    postings_of = postings(docs, grams, row_id, text) if index is None else index
    everywhere = {name for name, r in rules.items() if not trigram_query(r.pattern)}
    rows = docs.select(F.struct("*").alias("row"), _key(F.col(row_id), F.col(text)).alias("key"))
    if grams:
        rows = rows.join(candidates(postings_of, grams, rules), "key", "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<string>"))
    t = F.coalesce(F.col("row")[text], F.lit(""))
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")

    def spans(place: int, name: str, rule: Rule) -> Column:
        told = lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(name).alias("kind"))
        found = F.transform(matches(rule, t), told)
        return found if name in everywhere else F.when(F.array_contains("rules", name), found).otherwise(none)

    every = F.concat(none, *[spans(i, name, rule) for i, (name, rule) in enumerate(rules.items())])
    return rows.select("row", F.array_sort(every).alias("spans"))


def digest(found: DataFrame, base: Mapping[str, Rule] = BASE) -> DataFrame:
    """The report columns of ``find``'s rows: doc_id, counts of the base kinds, base_sha256, spans, n_added."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(of([kind])).cast("bigint").alias(f"n_{kind}") for kind in base],
        F.sha2(told(of(base)).cast("binary"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(of(base))).cast("bigint").alias("n_added"),
    )
