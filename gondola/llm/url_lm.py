"""URL filter by the ratio of two character language models, with built-in expressions only.

Rules judge a URL first: a rule fits its host and all subdomains if the path starts with the rule's path; the longest
rule wins. URLs that no rule fits are judged by two variable-order Markov models over characters, one of accepted and
one of rejected URLs. Each is smoothed by Witten-Bell interpolation from order 0 up to ``order``; a character is scored
under the longest context that training saw. The verdict compares the log-likelihood difference, divided by the number
of characters, with a threshold. The models learn from one half of the different URLs (by hash), and the threshold is
calibrated on the other half, which they haven't seen.

Null URLs and URLs without ``://`` have an empty host and path; with no characters to score they are always allowed. Rows are
independent; repeated URLs are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import materialize

#: (verdict, host, path) of the rules.
RULES: tuple[tuple[str, str, str], ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words in a host that mark a URL as rejected for training: public spam terms.
SPAM_TERMS = ("casino", "poker", "pills", "viagra", "cheap", "spam", "porn", "xxx", "loan", "replica", "jackpot", "torrent", "crack")


def parts(url: Column) -> dict[str, Column]:
    """host (A-Z lower-cased) and path of a URL."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return {"host": F.when(has, host).otherwise(""), "path": F.when(has, path).otherwise("")}


def rule_columns(rules: Sequence[tuple[str, str, str]] = RULES) -> dict[str, Column]:
    """rule and rule_verdict (null where none fits), over the columns host and path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return {"rule": name, "rule_verdict": verdict}


def training_label(terms: Sequence[str] = SPAM_TERMS) -> Column:
    """True for accepted, false for rejected: the host's words decide, as a blocklist would; rules are no evidence here,

    since they judge places (a top-level domain, a language's folder) and would teach the models only those.
    """
    hit = F.lit(False)
    for x in terms:
        hit = hit | F.contains("host", F.lit(x))
    return ~hit


def _grams(urls: DataFrame, order: int, keep: list[str]) -> DataFrame:
    """A row for each character of ``s``: its contexts k0 .. k<order> (each ends with the character itself)."""
    padded = F.concat(F.repeat(F.lit("\x02"), order), F.col("s"), F.lit("\x03"))
    at = urls.where(F.length("s") > 0).select(*keep, padded.alias("p")).select(*keep, "p", F.explode(F.sequence(F.lit(order + 1), F.length("p"))).alias("i"))
    return at.select(*keep, *[F.substring(F.col("p"), F.col("i") - k, F.lit(k + 1)).alias(f"k{k}") for k in range(order + 1)])


def fit(urls: DataFrame, order: int = 3, pseudo: float = 0.5, alphabet: int = 256) -> DataFrame:
    """urls: s, accepted. The table (k, gram, ratio): log P(accepted) - log P(rejected) of a gram's last character.

    Counts cover all rows. A context unseen in one of the models hands its character to the next shorter context.
    """
    both = _grams(urls, order, ["accepted"])
    stacked = both.select("accepted", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("gram")) for k in range(order + 1)])).alias("g"))
    counts = stacked.groupBy("g.k", "g.gram").agg(
        F.sum(F.when(F.col("accepted"), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("accepted"), 0).otherwise(1)).alias("r")
    )
    counts = materialize(counts)
    context = F.substring(F.col("gram"), F.lit(1), F.col("k"))
    seen = counts.groupBy(F.col("k").alias("k2"), context.alias("context")).agg(
        *[x for c in "ar" for x in (F.sum(c).alias(f"n{c}"), F.sum((F.col(c) > 0).cast("int")).alias(f"t{c}"))]
    )
    level = None
    for k in range(order + 1):
        rows = counts.where(F.col("k") == k).withColumn("context", context).join(seen.where(F.col("k2") == k).drop("k2"), "context")
        if level is None:
            low = {c: F.lit(1.0 / alphabet) for c in "ar"}
        else:
            rows = rows.withColumn("shorter", F.substring(F.col("gram"), F.lit(2), F.lit(k))).join(level.select(F.col("gram").alias("shorter"), "pa", "pr"), "shorter")
            low = {c: F.col(f"p{c}") for c in "ar"}
        p = {c: (F.col(c) + (F.col(f"t{c}") + pseudo) * low[c]) / (F.col(f"n{c}") + F.col(f"t{c}") + pseudo) for c in "ar"}
        level = materialize(rows.select(F.lit(k).alias("k"), "gram", p["a"].alias("pa"), p["r"].alias("pr")))
        ratio = level.select("k", "gram", (F.log("pa") - F.log("pr")).alias("ratio"))
        model = ratio if k == 0 else model.unionByName(ratio)
    return model


def score(urls: DataFrame, model: DataFrame, keep: list[str], order: int = 3, broadcast_rows: int = 200_000) -> DataFrame:
    """urls: ``keep`` (which tell rows apart) and s -> keep, score: mean log ratio a character; 0 for an empty s.

    The table of grams goes to every executor only while it has at most ``broadcast_rows`` rows; beyond that Spark
    shuffles for the join.
    """
    small = model.count() <= broadcast_rows
    rows = _grams(urls, order, keep)
    for k in range(order + 1):
        side = model.where(F.col("k") == k).select(F.col("gram").alias(f"k{k}"), F.col("ratio").alias(f"r{k}"))
        rows = rows.join(F.broadcast(side) if small else side, f"k{k}", "left")
    best = F.coalesce(*[F.col(f"r{k}") for k in range(order, -1, -1)], F.lit(0.0))
    return rows.groupBy(*keep).agg((F.sum(best) / F.count(F.lit(1))).alias("score"))


def threshold(scored: DataFrame, keep_share: float = 0.995) -> float:
    """scored: score, accepted. Half-way between the classes' bulks: the accepted's low and the rejected's median.

    With one class only, minus infinity (nothing more is blocked).
    """
    r = scored.agg(
        F.percentile_approx(F.when(F.col("accepted"), F.col("score")), 1 - keep_share, 10_000).alias("low"),
        F.percentile_approx(F.when(~F.col("accepted"), F.col("score")), 0.5, 10_000).alias("mid"),
    ).first()
    return float("-inf") if r["low"] is None or r["mid"] is None else (r["low"] + r["mid"]) / 2


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, order: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) for each row of ``pages``.

    Each different (host, path) is scored once: hosts that hold a third of all pages cost no more than their paths.
    """
    p = parts(F.col("url"))
    judged = pages.select("page_id", p["host"].alias("host"), p["path"].alias("path")).withColumns(rule_columns(rules))
    texts = judged.groupBy("host", "path").agg(F.first("rule_verdict").alias("rule_verdict")).withColumn("s", F.concat("host", F.col("path")))
    texts = materialize(texts.withColumn("accepted", training_label()))
    learnt = F.pmod(F.xxhash64("s", F.lit(17)), F.lit(2)) == 0
    model = fit(texts.where(learnt).select("s", "accepted"), order)
    scored = materialize(score(texts, model, ["host", "path", "accepted"], order))
    cut = threshold(scored.withColumn("s", F.concat("host", "path")).where(~learnt))
    free = judged.join(scored.select("host", "path", "score"), ["host", "path"], "left")
    verdict = F.when(F.coalesce(F.col("score") < cut, F.lit(False)), "block").otherwise("allow")
    return free.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", verdict).alias("verdict"), "score")
