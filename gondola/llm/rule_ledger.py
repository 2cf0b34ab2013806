"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps the measurements and one bit for each failed rule;
policies are versioned masks over those bits, so that a new policy, or an ablation of an old one, reads the ledger
and never the texts. Built-in expressions only; a document's row is never exploded, so nothing is shuffled.

Null texts count as empty (no words); rows are independent, so repeated ids, ties and extra columns change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import SPACES, let, words

#: Rule name -> failing condition, over the measurements. A rule's bit is its place in this mapping.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "capitals": "2 * n_capitals > word_chars",
}
#: The first two rules are the base: no policy can leave them out.
BASE = 0b11
#: Policy version -> mask of the rules that it applies.
POLICIES: dict[str, int] = {"v1": 0b0001111, "v2": 0b1111111}
CURRENT = "v2"


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included."""
    windows = F.when(
        F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(s: Column) -> Column:
        # s: (hash, place), sorted; equal neighbours are repeats. Their places, in order, cover three words each.
        hit = F.filter(
            s,
            lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]))
            | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == x["h"])),
        )
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.array_sort(F.transform(hit, lambda x: x["i"])),
            start,
            lambda a, p: F.struct((a["n"] + (p + 3 - F.greatest(p, a["end"]))).alias("n"), (p + 3).alias("end")),
            lambda a: a["n"],
        )

    return let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
        ),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All measurements as columns beside those of ``docs``; a column of the same name is replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("bigint")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    by_words = let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).alias("r")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), F.size(F.array_distinct(x)).cast("bigint").alias("d")))
    w, line = f"w_{uuid.uuid4().hex}", f"l_{uuid.uuid4().hex}"
    m = docs.withColumns({w: by_words, line: by_lines})
    return m.withColumns(
        {
            "n_words": F.col(w)["n"],
            "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("bigint"),
            "n_symbols": bare("#*$%&|<>"),
            "n_lines": F.col(line)["n"],
            "n_dup_lines": F.col(line)["n"] - F.col(line)["d"],
            "n_repeat_words": F.col(w)["r"],
            "n_capitals": bare("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        }
    ).drop(w, line)


def ledger(docs: DataFrame, rules: Mapping[str, str] = RULES, text: str = "text") -> DataFrame:
    """``measure`` plus ``fail_mask``: bit i is set when the i-th rule fails."""
    mask = F.lit(0).cast("bigint")
    for i, condition in enumerate(rules.values()):
        mask = mask.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return measure(docs, text).withColumn("fail_mask", mask)


def apply_policy(book: DataFrame, mask: int = POLICIES[CURRENT], base: int = BASE) -> DataFrame:
    """``base_failed`` and ``kept`` (no rule of the base or of the policy fails)."""
    hit = lambda m: F.col("fail_mask").bitwiseAND(F.lit(m).cast("bigint")) != 0
    return book.withColumns({"base_failed": hit(base), "kept": ~hit(mask | base)})


def ablations(book: DataFrame, policies: Mapping[str, int] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """For each policy and rule: documents that fail the rule, and those that would be kept without it.

    One row for each pair, from a single aggregation over the masks (a partial one on each partition first).
    """
    one = lambda c: F.sum(c.cast("bigint"))
    mask, cols = F.col("fail_mask"), [F.count(F.lit(1)).alias("n_docs"), F.bit_or("fail_mask").alias("any_failed")]
    for p, m in policies.items():
        m |= BASE
        for i, r in enumerate(rules):
            if m >> i & 1:
                held = mask.bitwiseAND(F.lit(m).cast("bigint"))
                cols += [one(held.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0).alias(f"f_{p}_{r}"), one(held == (1 << i)).alias(f"o_{p}_{r}")]
    wide = book.agg(*cols)
    rows = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.coalesce(f"f_{p}_{r}", F.lit(0)).alias("n_failed"), F.coalesce(f"o_{p}_{r}", F.lit(0)).alias("n_only_this"))
        for p, m in policies.items() for i, r in enumerate(rules) if (m | BASE) >> i & 1
    ]
    return wide.select("n_docs", F.explode(F.array(*rows)).alias("x")).select("n_docs", "x.*")
