"""Personal data by weak supervision, with built-in expressions only.

Base spans come from exact patterns (email, ip, card, phone). Beyond them, broader patterns propose candidate spans;
labelers (shape, gazetteer, context, neighbourhood) each vote for, against or abstain on every candidate. The votes of
the whole corpus are counted by vote pattern: a table of at most 3^5 x 5 rows, whatever the corpus. On it,
expectation-maximisation estimates each labeler's reliability without any truth, and its posteriors train a logistic
span classifier, which decides on every candidate. Candidates that touch a base span are never added.

Offsets are code points, end exclusive. Null texts are empty and have no spans. Matches are found left to right and do
not overlap within a kind. Rows are independent: repeated ids, ties and extra columns change nothing.

The patterns use possessive quantifiers and start only where a run starts (or a match just ended), which finds the same
matches as the plain form in time linear in the text, however long a run of characters is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import let, scan

# fixed values: patterns of the base kinds, in the order of report
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# fixed values: patterns that propose further spans
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,200}+(?![A-Za-z0-9_/+-])",
    "number": r"(?<![0-9A-Za-z.,+-])[(]?[0-9]{2,4}[)]?(?:[ .-][0-9]{2,7}){1,4}(?![0-9A-Za-z])",
    "spoken": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}+){1,8}",
}
#: A text with none of the pieces can't hold a match: a cheap test before the pattern.
NEEDS = {"email": ("@",), "ip": (".",), "phone": ("+",), "spoken": ("(", "[")}
# fixed values: gazetteers
SECRET_WORDS = "token|secret|key|apikey|api_key|password|passwd|pwd|bearer|auth|credential"
PERSON_WORDS = "tel|phone|fon|mobile|mobil|call|fax|ssn|social|passport|iban|account|konto|compte|cuenta|mail|email|contact|reach"
LABELERS = ("shape", "gazetteer", "context", "mixture", "neighbours")
KINDS = (*BASE, *CANDIDATES)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)

    def add(a: Column, i: Column) -> Column:
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    d = _digits(m)
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.nullif(F.right(F.ltrim(p, F.lit("0")), F.lit(3)), F.lit("")), F.lit("999")).cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return F.length(d).between(13, 19) & let(d, _luhn)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,end:int,m:string>>"


def _find(kind: str, pattern: str, t: Column) -> Column:
    """Spans of ``pattern`` in ``t``: what lies between matches gives the places of the matches."""
    none = F.array().cast(SPAN)

    def places(ms: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            begin = at + F.length(x["gap"])
            end = begin + F.length(x["m"])
            return end, F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m"))).cast(SPAN)

        pairs = F.zip_with(F.split(t, pattern, -1), ms, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        return F.when(F.size(ms) == 0, none).otherwise(scan(F.filter(pairs, lambda x: x["m"].isNotNull()), F.lit(0), "int", "struct<start:int,end:int,m:string>", step))

    found = let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), places)
    if kind in NEEDS:
        piece = reduce(Column.__or__, [F.contains(t, F.lit(x)) for x in NEEDS[kind]])
        found = F.when(piece, found).otherwise(none)
    return found if kind == "email" else F.filter(found, lambda s: _passes(kind, s["m"]))


def base_spans(text: Column) -> Column:
    """struct<email, ip, card, phone>, each an array of (start, end, m) in order."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(*[_find(k, p, t).alias(k) for k, p in BASE.items()])


def _votes(kind: str, s: Column) -> Column:
    """struct of a vote (1, 0, -1) a labeler, and a length class."""
    m, n, before, after = s["m"], F.length(s["m"]), F.lower(s["before"]), s["after"]
    digits = n - F.length(F.translate(m, "0123456789", ""))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    names = SECRET_WORDS if kind == "secret" else PERSON_WORDS
    gazetteer = vote(before.rlike(rf"(?:^|[^a-z])(?:{names})[^a-z]"), before.rlike(r"(?:isbn|issn|version|page|chapter|http|www)[^a-z]"))
    context = vote(before.rlike(r"""[=:]\s*["']?$"""), before.rlike(r"""[/#$€]\s*$"""))
    if kind == "secret":
        shape = vote(m.rlike("^(?:[0-9a-fA-F]{32,}|[A-Za-z]{2,6}[_-][A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16})$"), m.rlike("^[A-Za-z_/+-]+$") | m.rlike("^[0-9_/+-]+$"))
        mixture = vote((digits * 6 >= n) & (digits * 10 <= n * 9), digits == 0)
    elif kind == "number":
        shape = vote(m.rlike(r"^(?:[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"), m.rlike(r"^[0-9]{4}[ .-][0-9]{2}[ .-][0-9]{2}$") | m.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}$"))
        mixture = vote(digits.between(9, 15), digits < 7)
    else:
        shape, mixture = F.lit(1), vote(n >= 10, n < 8)
    neighbours = vote(after.rlike("^[\"']"), after.rlike(r"^\s*[%*/=€$|]") | before.rlike(r"[0-9]\s*$"))
    votes = dict(zip(LABELERS, (shape, gazetteer, context, mixture, neighbours), strict=True))
    return F.struct(*[v.cast("int").alias(k) for k, v in votes.items()], F.least(F.floor(n / 16), F.lit(4)).cast("int").alias("size"))


EVENT = "struct<start:int,who:int,end:int,m:string,before:string,after:string>"


def _proposed(kind: str, pattern: str, t: Column) -> Column:
    """array<EVENT> of the matches of ``pattern``, with up to 24 characters before and 8 after (up to the next match's end)."""
    none = F.array().cast(f"array<{EVENT}>")

    def places(pairs: Column) -> Column:
        def step(a: Column, x: Column) -> tuple[Column, Column]:
            begin, before = a["at"] + F.length(x["gap"]), F.right(F.concat(a["tail"], x["gap"]), F.lit(24))
            end = begin + F.length(x["m"])
            one = F.struct(begin.alias("start"), F.lit(1).alias("who"), end.alias("end"), x["m"].alias("m"), before.alias("before"), F.left(x["next"], F.lit(8)).alias("after"))
            return F.struct(end.alias("at"), F.right(F.concat(before, x["m"]), F.lit(24)).alias("tail")), F.array(one)

        nxt = lambda i: F.concat(F.get(pairs, i + 1)["gap"], F.coalesce(F.get(pairs, i + 1)["m"], F.lit("")))
        items = F.transform(F.slice(pairs, 1, F.size(pairs) - 1), lambda x, i: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), nxt(i).alias("next")))
        return scan(items, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), "struct<at:int,tail:string>", EVENT, step)

    def found(ms: Column) -> Column:
        pairs = F.zip_with(F.split(t, pattern, -1), ms, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        return F.when(F.size(ms) == 0, none).otherwise(let(pairs, places))

    every = let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), found)
    if kind in NEEDS:
        every = F.when(reduce(Column.__or__, [F.contains(t, F.lit(x)) for x in NEEDS[kind]]), every).otherwise(none)
    return every


def _free(found: Column, base: Column) -> Column:
    """Those of ``found`` that touch no base span: one pass over both in order of their starts."""
    span = lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("who"), s["end"].alias("end"), *[F.lit("").alias(x) for x in ("m", "before", "after")])
    none, nobody = F.array().cast(f"array<{EVENT}>"), F.lit(None).cast(EVENT)

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        is_base, open_ = x["who"] == 0, a["open"]
        hit = is_base & open_.isNotNull() & (x["start"] < open_["end"])
        kept = F.when(hit, nobody).when(is_base, open_).when(x["start"] < a["upto"], nobody).otherwise(x)
        upto = F.when(is_base, F.greatest(a["upto"], x["end"])).otherwise(a["upto"])
        return F.struct(upto.alias("upto"), kept.alias("open")), F.when(~is_base & open_.isNotNull(), F.array(open_)).otherwise(none)

    def all_of(fs: Column) -> Column:
        events = F.array_sort(F.concat(fs, *[F.transform(base[k], span) for k in BASE]))
        last = lambda a: F.when(a["open"].isNotNull(), F.array(a["open"])).otherwise(none)
        start = F.struct(F.lit(0).alias("upto"), nobody.alias("open"))
        return F.when(F.size(fs) == 0, none).otherwise(scan(events, start, f"struct<upto:int,open:{EVENT}>", EVENT, step, last))

    return let(found, all_of)


def candidates(text: Column, base: Column) -> Column:
    """array<struct<kind, start, end, m, v>> of candidate spans that touch no base span."""
    t = F.coalesce(text, F.lit(""))
    judged = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), _votes(kind, s).alias("v"))
    return F.concat(*[F.transform(_free(_proposed(kind, pattern, t), base), judged(kind)) for kind, pattern in CANDIDATES.items()])


@dataclass
class SpanModel:
    """``accuracy``: a labeler's estimated reliability, by kind; ``weights``: of the span classifier, by kind."""

    prior: dict[str, float] = field(default_factory=dict)
    accuracy: dict[str, dict[str, float]] = field(default_factory=dict)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)


def _features(votes: dict[str, int], size: int) -> dict[str, float]:
    return {"bias": 1.0} | {f"{k}+": float(v > 0) for k, v in votes.items()} | {f"{k}-": float(v < 0) for k, v in votes.items()} | {f"size{size}": 1.0}


def fit_patterns(patterns: list[tuple[str, dict[str, int], int, int]], rounds: int = 50, steps: int = 400) -> SpanModel:
    """EM and the classifier, on (kind, votes, size class, count) rows: a few hundred at most.

    A labeler that votes is right with probability ``accuracy``; it abstains alike for either class. Starts from 0.8,
    smoothed by ten pseudo-votes at 0.8, so that unanimous or very small corpora stay defined.
    """
    model = SpanModel()
    for kind in CANDIDATES:
        rows = [(v, s, float(n)) for k, v, s, n in patterns if k == kind]
        prior, acc = 0.5, dict.fromkeys(LABELERS, 0.8)
        post = [0.5] * len(rows)
        for _ in range(rounds if rows else 0):
            for i, (v, _, _) in enumerate(rows):
                odds = math.log(prior / (1 - prior)) + sum(v[k] * math.log(acc[k] / (1 - acc[k])) for k in LABELERS)
                post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            total = sum(n for _, _, n in rows)
            prior = min(0.95, max(0.05, (1 + sum(p * n for p, (_, _, n) in zip(post, rows, strict=True))) / (2 + total)))
            for k in LABELERS:
                right = sum(n * (p if v[k] > 0 else 1 - p) for p, (v, _, n) in zip(post, rows, strict=True) if v[k])
                acc[k] = min(0.98, max(0.55, (8 + right) / (10 + sum(n for v, _, n in rows if v[k]))))
        w: dict[str, float] = {}
        total = sum(n for _, _, n in rows) or 1.0
        data = [(_features(v, s), n / total, p) for (v, s, n), p in zip(rows, post, strict=True)]
        for _ in range(steps if data else 0):
            grad: dict[str, float] = {}
            for f, n, p in data:
                z = sum(w.get(k, 0.0) * x for k, x in f.items())
                d = n * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
                for k, x in f.items():
                    grad[k] = grad.get(k, 0.0) + d * x
            w = {k: w.get(k, 0.0) - 2.0 * (g + 1e-4 * w.get(k, 0.0)) for k, g in grad.items()}
        model.prior[kind], model.accuracy[kind], model.weights[kind] = prior, acc, w
    return model


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (see ``base_spans``) and ``cands`` (see ``candidates``): the one scan of the texts."""
    return docs.withColumn("base", base_spans(F.col(text))).withColumn("cands", candidates(F.col(text), F.col("base")))


def fit(annotated: DataFrame) -> SpanModel:
    """Counts the vote patterns over all documents; the grouped table has a proven bound (see the module's text)."""
    counted = annotated.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.v").count().collect()
    rows = [(r["kind"], {k: r["v"][k] for k in LABELERS}, r["v"]["size"], r["count"]) for r in counted]
    return fit_patterns(sorted(rows, key=str))


def _accepted(model: SpanModel, c: Column) -> Column:
    score = F.lit(-1.0)
    for kind, w in model.weights.items():
        z = F.lit(w.get("bias", -1.0))
        for k in LABELERS:
            z = z + F.when(c["v"][k] > 0, w.get(f"{k}+", 0.0)).when(c["v"][k] < 0, w.get(f"{k}-", 0.0)).otherwise(0.0)
        for s in range(5):
            z = z + F.when(c["v"]["size"] == s, w.get(f"size{s}", 0.0)).otherwise(0.0)
        score = F.when(c["kind"] == kind, z).otherwise(score)
    return score > 0


def decide(annotated: DataFrame, model: SpanModel) -> DataFrame:
    """``annotate``'s rows with ``added`` (accepted candidates: kind, start, end) in place of ``cands``."""
    kept = F.filter("cands", lambda c: _accepted(model, c))
    return annotated.withColumn("added", F.transform(kept, lambda c: F.struct(*[c[x].alias(x) for x in ("kind", "start", "end")]))).drop("cands")


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``added``. The texts are scanned twice, for the votes and for the result: a table of
    them would double the space that they take.
    """
    annotated = annotate(docs)
    return decide(annotated, fit(annotated))


def digest(found: DataFrame) -> DataFrame:
    """The report columns of each row of ``decide``; spans by kind as listed, then start."""
    text = lambda kind, spans: F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))
    base = F.concat(*[text(k, F.col(f"base.{k}")) for k in BASE])
    of = lambda kind: F.array_sort(F.transform(F.filter("added", lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    more = F.concat(*[text(k, of(k)) for k in CANDIDATES])
    return found.select(
        "doc_id",
        *[F.size(f"base.{k}").cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``decide``'s rows with every span replaced by its kind in angle brackets; spans that overlap count as one."""
    part = lambda kind, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    every = F.array_sort(F.concat(*[part(k, F.col(f"base.{k}")) for k in BASE], F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    t, kind = F.col(text), "struct<start:int,end:int,kind:string>"

    # spans that start inside an earlier one go; it reaches to the end of the last that does
    def merged(a: Column, s: Column) -> tuple[Column, Column]:
        wider = F.struct(a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"), a["kind"].alias("kind"))
        apart = a.isNull() | (s["start"] >= a["end"])
        return F.when(apart, s).otherwise(wider), F.when(apart & a.isNotNull(), F.array(a)).otherwise(F.array().cast(f"array<{kind}>"))

    spans = scan(every, F.lit(None).cast(kind), kind, kind, merged, lambda a: F.when(a.isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array(a)))

    def clean(ms: Column) -> Column:
        # a block of spans cuts its own piece of the text: to find a place in a text takes time in the text's length
        after = lambda j: F.when(j > 0, F.get(ms, j - 1)["end"]).otherwise(0)

        def block(first: Column, end: Column) -> Column:
            def pieces(piece: Column) -> Column:
                one = lambda j: F.concat(F.substring(piece, after(j) - after(first) + 1, F.get(ms, j)["start"] - after(j)), F.lit("<"), F.upper(F.get(ms, j)["kind"]), F.lit(">"))
                return F.array_join(F.transform(F.sequence(first, end), one), "")

            return let(F.substring(t, after(first) + 1, F.get(ms, end)["start"] - after(first)), pieces)

        last = F.size(ms) - 1
        starts = F.sequence(F.lit(0), F.floor(last / 128).cast("int"))
        blocks = F.transform(starts, lambda i: block(i * 128, F.least(i * 128 + 127, last)))
        return F.when(last < 0, t).otherwise(F.concat(F.array_join(blocks, ""), F.substring(t, F.get(ms, last)["end"] + 1, F.length(t))))

    return found.withColumn(text, F.when(F.size(every) > 0, let(spans, clean)).otherwise(t)).drop("base", "added")
