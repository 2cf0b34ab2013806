"""Each operator against a plain version of its definition."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gondola.llm import bwt_dedup, compact_windows, fm_decontam, license_scan, minmax_dedup, pii_weak, pivotal_mix, queries, rule_ledger, url_lm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def groups(sets, percent=80):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def shingles(t, k):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_dedup(spark, texts):
    got = {r["doc_id"]: r for r in queries.op2_minmax_near_dedup(spark, SF).collect()}
    sets = {d: shingles(t, 2) for d, t in texts.items()}
    want = groups(sets)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (want[d] == d) for d, r in got.items())


def test_near_dedup_of_a_large_group_and_odd_rows(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(words)
        for j in range(i % 7):
            w[(i * 13 + j * 29) % 200] = f"x{i}{j}"
        rows.append((1000 - i, " ".join(w), "extra"))
    rows += [(1, None, "a"), (2, "", "b"), (3, "one", "c"), (4, "ONE", "d"), (None, "one", "e"), (5, "solo text of its own", "f"), (5, "solo text of its own", "g")]
    got = minmax_dedup.link(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string"), k=2).collect()
    want = groups({d: shingles(t, 2) for d, t, _ in rows if d is not None})
    assert len(got) == len(rows)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [3]


def test_near_dedup_of_nothing(spark):
    assert minmax_dedup.link(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def brute_contamination(text, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, names = find(text), set(), set()
    for name, item in items:
        v = find(item)
        n = min(window, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(name)
    return len(w), len(hit), sorted(names)


def test_decontamination(spark):
    items = [("9", "alpha beta gamma"), ("10", " ".join(f"k{i}" for i in range(30))), ("2", "zebra"), ("7", None), ("8", "..")]
    rows = [
        (1, "x alpha BETA, gamma alpha beta gamma y"), (2, " ".join(f"K{i}" for i in range(5, 25))), (3, None), (4, ""), (5, "zebra"), (5, "zebra zebra b"),
        (6, " ".join(f"k{i}" for i in range(12))), (None, "alpha beta gamma"), (7, "é" * 3000 + " zebra " + "alpha beta gamma " * 500), (8, " ".join(f"k{i}" for i in range(30)) * 2),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = fm_decontam.contamination(df, bench).collect()
    assert len(got) == len(rows)
    for r, (d, t) in zip(got, rows, strict=True):
        n, hit, names = brute_contamination(t, items)
        assert (r["doc_id"], r["n_words"], r["n_hit"], r["items"]) == (d, n, hit, names)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    unique = df.where("NOT doc_id <=> 5")
    blocks = fm_decontam.contamination(unique, bench, block_mb=1e-5).collect()
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in blocks) == sorted((r["n_words"], r["n_hit"], r["items"]) for r in got if r["doc_id"] != 5)


def test_rules(spark, docs):
    for r in queries.op5_rule_ledger(spark, SF).join(docs, "doc_id").collect():
        w, t = WORD.findall(r["text"]), r["text"]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(tri)
        repeat = {i + k for i, x in enumerate(tri) if seen[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w))


def test_rule_ablations_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b c " * 40), (4, " ".join(f"word{i}" for i in range(60)))], "doc_id bigint, text string")
    book = rule_ledger.ledger(df)
    kept = {r["doc_id"]: r["kept"] for r in rule_ledger.apply_policy(book).collect()}
    assert kept == {1: False, 2: False, 3: False, 4: True}
    rows = {(r["policy"], r["rule"]): (r["n_docs"], r["n_failed"], r["n_only_this"]) for r in rule_ledger.ablations(book).collect()}
    assert rows["v2", "few_words"] == (4, 2, 2)
    assert rows["v2", "repeated_words"][:2] == (4, 1)


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    rules = [("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/")]
    fit = [h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=len) if fit else None


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q=1#f", "https://example.net?x=/en/", "http://x.org/fr/1", "http://net/", "http://internet", "x://b.example.com/de/://", "http://cheap-pills.example.com/en/1"]
    urls += [f"http://site{i}.example.com/en/{i}" for i in range(60)] + [f"http://cheap-pills{i}.example.com/en/{i}" for i in range(20)] + ["http://cheap-pelts.example.com/en/1"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r["page_id"]: r for r in url_lm.filter_urls(df).collect()}
    verdicts = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for i, u in enumerate(urls):
        r = got[i]
        host, path, rule = brute_url(u)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert rule is None or r["verdict"] == verdicts[rule]
    assert got[0]["verdict"] == "allow"
    assert [got[i]["verdict"] for i in (10, len(urls) - 1, 20)] == ["block", "block", "allow"]


def test_url_model_probabilities_sum_to_one(spark):
    urls = spark.createDataFrame([("abab", True), ("abba", True), ("bbbb", False)], "s string, accepted boolean")
    model = {(r["k"], r["gram"]): r["ratio"] for r in url_lm.fit(urls, order=1).collect()}
    # order 0 of accepted: a 4, b 4, end 2 of 10, three kinds; of rejected: b 4, end 1 of 5, two kinds
    pa = (4 + (3 + 0.5) / 256) / (10 + 3 + 0.5)
    pr = (0 + (2 + 0.5) / 256) / (5 + 2 + 0.5)
    assert abs(model[0, "a"] - np.log(pa / pr)) < 1e-9


def test_url_scores(spark):
    """Scores against a plain version of the smoothed models; an empty URL stays also where the threshold is high."""
    accepted, rejected, order = ["good.org/a", "good.org/b", "fine.org/", "good.org/a"], ["bad.biz/x", "bad.biz/yy", "evil.biz/"], 3
    urls = spark.createDataFrame([(u, True) for u in accepted] + [(u, False) for u in rejected], "s string, accepted boolean")
    tests = ["good.biz/zz", "bad.org/a", "", "qqq"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "page int, s string")
    got = {r["page"]: r["score"] for r in url_lm.score(rows, url_lm.fit(urls, order), ["page"], order).collect()}
    grams = lambda u: [("\x02" * order + u + "\x03")[i - order : i + 1] for i in range(order, order + len(u) + 1)]
    counts = [Counter(g[-k - 1 :] for u in us for g in grams(u) for k in range(order + 1)) for us in (accepted, rejected)]

    def p(c, gram):
        low = p(c, gram[1:]) if len(gram) > 1 else 1 / 256
        here = {g: n for g, n in c.items() if len(g) == len(gram) and g[:-1] == gram[:-1]}
        return (c[gram] + (len(here) + 0.5) * low) / (sum(here.values()) + len(here) + 0.5)

    for i, t in enumerate(tests):
        if not t:
            assert i not in got
            continue
        want = []
        for g in grams(t):
            known = next((g[-k - 1 :] for k in range(order, -1, -1) if counts[0][g[-k - 1 :]] + counts[1][g[-k - 1 :]]), None)
            want.append(np.log(p(counts[0], known) / p(counts[1], known)) if known else 0.0)
        assert abs(got[i] - np.mean(want)) < 1e-9, t


def test_mix(spark, texts, docs):
    size = {d: len(WORD.findall(t or "")) for d, t in texts.items()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = queries.op7_pivotal_mix(spark, SF).collect()
    again = {(r["doc_id"], r["taken"]) for r in queries.op7_pivotal_mix(spark, SF).collect()}
    assert {(r["doc_id"], r["taken"]) for r in rows} == again
    assert len(rows) == len(texts) and all(r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] for r in rows)
    per = Counter()
    for d, s in source.items():
        per[s] += size[d]
    names = sorted(per, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(per.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * per[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s], rest = 3.0 * per[s], rest - 3.0 * per[s]
        open_ -= full
    taken, largest = Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["source_size"] == per[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["copies"] in (int(target[s] / per[s]), int(target[s] / per[s]) + 1)
    assert all(abs(taken[s] - target[s]) <= 1.5 * largest[s] for s in names)


def test_mix_levels_and_odd_rows(spark):
    rows = [(i if i % 7 else None, "w " * (i % 50 + 1) + str(i), "a" if i % 3 else "b", 1, 2) for i in range(3000)] + [(9000, None, None, 1, 2), (9001, "x", None, 1, 2), (9002, "", "z", 1, 2), (9003, "v " * 5000, "b", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, target int")
    got = pivotal_mix.mix(df, block_rows=20).collect()
    assert len(got) == len(rows)
    for s in ("a", "b"):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 0.02 * mine[0]["target"]
    assert pivotal_mix.mix(df.limit(0)).collect() == []


def brute_removed(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for (d, _), x in zip(rows, raw, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8)])) > 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((d, len(x), int(gone.sum()), int(edge.sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"most": 1}, {"most": 3, "widths": (100, 30, 7, 1)}])
def test_bwt_dedup(spark, texts, how):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage, line = text(700), text(180)
    rows = [(i, t) for i, t in sorted(texts.items())[:60]]
    rows += [(1000 + i, text(int(rng.integers(0, 300))) + passage[: int(rng.integers(150, 700))] + text(50) + line) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "ab" * 5000), (2003, text(5000) * 2), (2004, passage), (2004, passage), (None, passage[10:250]), (2005, text(199)), (2006, rows[3][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, key int")
    got = [tuple(r) for r in bwt_dedup.dedup(df, **how).collect()]
    assert sorted(got, key=str) == sorted(brute_removed(rows), key=str)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = []
    for kind, p in KINDS.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, texts):
    odd = [
        None, "", "a@b.co x_y@z.org.uk_q@r.de", "é 1.2.3.4.5 999.1.2.3 0001.02.3.255 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 5", "+1 (852) 555-9747 +1 2 +49-30-1234567890123456",
        "+12345678901 4111111111111111" * 3, "a" * 50_000 + "@b.c", "1" * 20_000 + ".2.3.4", "." * 5000 + "@x.y", 'token = "64be64439e3e49cf46b2d7c90f3602a3d0b907ff" and phone: (555) 123-4567.',
        "user@host " + "a.b." * 3000 + "@q.r" + ".s" * 5000, "𝔘𝔫𝔦 me@x.io 𝔠",
    ]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + d, t) for d, t in texts.items()]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, kind string")
    found = pii_weak.detect(df)
    got = {r["doc_id"]: r for r in pii_weak.digest(found).collect()}
    for d, t in rows:
        want = brute_spans(t)
        r = got[d]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (d, want, r["spans"])
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in KINDS] == want
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(x.startswith(k) for x in want) for k in KINDS)
    assert "secret:9:49" in got[10]["spans"]
    clean = {r["doc_id"]: r["text"] for r in pii_weak.redact(found).collect()}
    assert clean[0] is None and clean[12] == "𝔘𝔫𝔦 <EMAIL> 𝔠"
    assert clean[2] == "<EMAIL> <EMAIL><EMAIL>"
    assert all(clean[d] == t for d, t in rows if d >= 100 and not got[d]["spans"])


def test_licenses(spark, texts):
    cut = license_scan.TEMPLATES["mit-header"].rsplit(" ", 2)[0]
    odd = [(905, cut), (906, "y " * 99 + cut + " z" * 99), (907, license_scan.TEMPLATES["mit-text"]), (907, license_scan.TEMPLATES["mit-text"]), (900, None), (901, ""), (902, "RELEASED under the\nMIT license"), (903, "licensed under the apache licence version 2"), (904, "x " * 500 + license_scan.TEMPLATES["mit-header"])]
    rows = [*texts.items(), *odd]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, license int")
    got = {(r["doc_id"], r["license"]): (round(r["containment"], 9), r["first_word"]) for r in license_scan.scan(df).collect()}
    want = defaultdict(list)
    for d, t in rows:
        w = license_scan.words_of(t or "")
        for name, template in license_scan.TEMPLATES.items():
            n, s = len(license_scan.words_of(template)), set(license_scan.shingles_of(template))
            for a in range(0, len(w), n // 4 + 1):
                v = w[a : a + n + n // 4]
                share = len(s & {" ".join(v[i : i + 5]) for i in range(len(v) - 4)}) / len(s)
                if share >= 0.8:
                    want[d, name].append((round(share, 9), -a))
    assert got == {k: (max(v)[0], -max(v)[1]) for k, v in want.items()}
    assert {(902, "mit"), (904, "mit-header"), (905, "mit-header"), (906, "mit-header"), (907, "mit-text")} <= set(got)


def brute_windows(v, width):
    out = set()
    for c in range(len(v)):
        left = right = c
        while left > 0 and v[left - 1] > v[c]:
            left -= 1
        while right + 1 < len(v) and v[right + 1] >= v[c]:
            right += 1
        if right - left + 1 >= width:
            out.add((left, c, right))
    return out


def test_compact_windows_are_those_of_the_tree():
    rng = np.random.default_rng(1)
    sizes = [0, 3, 50, 400, 7, 129, 0, 64]
    at = np.concatenate([[0], np.cumsum(sizes)])
    value = rng.integers(1, 1 << 63, at[-1], dtype=np.uint64)
    value[10:40:3] = value[12]
    for width in (2, 5, 16, 45):
        got = set(zip(*(x.tolist() for x in compact_windows.windows(value, at, width)), strict=True))
        want = {tuple(at[i] + x for x in w) for i in range(len(sizes)) for w in brute_windows(value[at[i] : at[i + 1]].tolist(), width)}
        assert got == want


def test_near_passages(spark):
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    passage = words(120)
    near = list(passage)
    near[40], near[80] = "other", "another"
    short = words(40)
    rows = [(i, " ".join(words(200))) for i in range(30)]
    rows += [(100, " ".join(words(50) + passage + words(60))), (101, " ".join(words(300) + near)), (102, " ".join(passage[:70] + words(80))), (103, " ".join(passage[:45] + words(90)))]
    rows += [(200 + i, " ".join(words(60) + short + words(60))) for i in range(20)]
    rows += [(300, rows[3][1]), (301, " ".join(words(30))), (302, None), (303, ""), (304, " ".join(rows[-1][1].split() or words(55)))]
    rows += [(305, rows[-1][1].upper()), (306, " ".join(passage + words(30) + passage)), (None, " ".join(words(5) + passage))]
    got = {r["doc_id"]: r for r in compact_windows.near_passages(spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id bigint, text string, rep int")).collect()}
    assert set(got) == {100, 101, 102, 3, 219, 300, 304, 305, 306, None}
    assert got[100]["spans"] == "50:170" and got[101]["spans"] == "300:420" and got[102]["spans"] == "0:70"
    assert (got[3]["spans"], got[3]["copies"], got[3]["like_id"]) == ("0:200", 2, 3)
    assert got[306]["spans"] == "0:120,150:270"


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert compact_windows.near_passages(empty).collect() == []
    assert bwt_dedup.dedup(empty).collect() == []
    assert license_scan.scan(empty).collect() == []
    assert rule_ledger.ledger(empty).collect() == []
    assert pii_weak.digest(pii_weak.detect(empty)).collect() == []
    assert fm_decontam.contamination(empty, spark.createDataFrame([], "item_id bigint, text string")).collect() == []
    assert url_lm.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).collect() == []
