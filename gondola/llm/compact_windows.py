"""Near-duplicate passages by compact windows.

Tokens are five-word shingles of the lower-cased text. Under one hash, all subsequences that share the same smallest
token form few groups: a window (l, c, r) stands for every subsequence that begins in [l, c] and ends in [c, r], where
c holds the smallest hash between l and r. These are the nodes of the Cartesian tree over the token hashes; those at
least ``width`` tokens wide are kept, about 2 / width a token.

One hash alone would bring together all texts that share a frequent phrase. So hashes are taken two by two: where two
windows of a text, one of either hash, overlap such that one subsequence lies in both, their intersection (l, first c,
last c, r) stands for all subsequences with that pair of smallest tokens; pairs count that lie in ``width`` tokens, as a longer passage has such
parts. Two passages of similarity s lie in windows
of equal keys with probability s^2 for a pair; with 4 pairs one of them agrees with probability 0.983 at similarity
0.8 (0.994 at 0.85, 0.9987 at 0.9), and a longer passage has more than one chance.

Windows of one key in one text are compared where they are made, each with the one before it; those that a passage so
verified links to it are stood for by the first. In each of ``rounds`` rounds all windows of a key are compared with one
leader. Then the windows that lie in no confirmed span meet the other windows of their key, confirmed ones included, inside
a task: by sketches of 64 bits (about half of the tokens on one side of the place are common; a passage at the threshold has
nine tenths of them), then by the tokens around them, of which a stretch of ``min_words`` words must be alike enough. Each is
compared with the best of these, and what is still open with all of them. The collisions of a pair of
texts, under all keys, are joined as intervals that overlap in both texts, and make candidate regions; the regions'
words are then compared. A passage is verified where its distinct shingles and those of its counterpart have similarity
0.8 or more and both have ``min_words`` words.

Texts with equal bytes are folded first: each copy is a repeat as a whole, and one of them goes on. Null, empty and
short texts have no passages. Rows that repeat an id are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.arrays import NON_SPACE, U64, Texts, mix
from gondola.llm.common import forget, let_go, materialize, scan

SHINGLE = 5

# Once a block of this size was given back, glibc keeps smaller ones instead of mapping (and zeroing) pages for each array anew.
np.empty(24 << 20, np.uint8)


def windows(value: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), ends included, of all compact windows of at least ``width`` tokens; text i has tokens at[i] .. at[i + 1].

    A token's window ends where the next smaller token (ties: an equal one to the left) stands. Both are found by
    descending through minima of stretches of 2^j tokens, for the tokens alone that are smallest in some stretch of
    ``width`` tokens; a 0 between texts stops every search.
    """
    n, texts = len(value), len(at) - 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none
    m = n + texts + 1
    low = U64((1 << max(26, m.bit_length())) - 1)
    place = np.arange(n) + np.repeat(np.arange(texts), np.diff(at)) + 1
    v = np.zeros(m, U64)
    # the hash's upper bits, then the place: ties go to the left
    v[place] = (value | U64(1 << 63)) & ~low | place.astype(U64)
    levels = [v]
    # a stretch longer than any text holds a 0
    for j in range(1, int(np.diff(at).max()).bit_length()):
        levels.append(np.minimum(levels[-1][: -(1 << (j - 1))], levels[-1][1 << (j - 1) :]))
    k = width.bit_length() - 1
    if k >= len(levels):
        return none, none, none
    least = np.minimum(levels[k][: m - width + 1], levels[k][width - (1 << k) : m - (1 << k) + 1])
    # the smallest token's place never goes back as the stretch goes on
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    c = (least[least > 0] & low).astype(np.int64)
    if not len(c):
        return none, none, none
    own = v[c]
    left, right = c.copy(), c + 1
    # the first and the last stretch of each level hold a 0, so that places beyond them stop, too
    for j in range(len(levels) - 1, -1, -1):
        step, lev = 1 << j, levels[j]
        left -= step * (lev.take(left - step, mode="clip") > own)
        right += step * (lev.take(right, mode="clip") > own)
    back = np.zeros(m, np.int64)
    back[place] = np.arange(n)
    return back[left], back[c], back[right - 1]


def _tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and where each text's begin."""
    w = t.words(NON_SPACE)
    h, owner, _ = w.shingles(SHINGLE)
    h = h[w.n[owner] >= SHINGLE]
    return h, np.concatenate([[0], np.cumsum(np.maximum(w.n - SHINGLE + 1, 0))])


def crossed(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], width: int) -> tuple[np.ndarray, ...]:
    """(window of one, window of two, l, first c, last c, r) where a subsequence of just ``width`` tokens lies in both."""
    (l1, c1, r1), (l2, c2, r2) = one, two
    first = np.searchsorted(c2, np.maximum(l1, c1 - width + 1))
    many = np.searchsorted(c2, np.minimum(r1, c1 + width - 1), "right") - first
    i = np.repeat(np.arange(len(c1)), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    low, high = np.maximum(l1[i], l2[j]), np.minimum(r1[i], r2[j])
    begin, end = np.minimum(c1[i], c2[j]), np.maximum(c1[i], c2[j])
    on = (low <= begin) & (end <= high) & (high - low + 1 >= width)
    return i[on], j[on], low[on], begin[on], end[on], high[on]


def stretches(hits: list[tuple[int, int, int]], slack: int = 8) -> list[list[int]]:
    """(low, high, shift) of collisions, by start -> [low, high, least shift, greatest shift] of the regions they cover; a
    stretch joins all open regions that it overlaps at a like shift.
    """
    done: list[list[int]] = []
    near: list[list[int]] = []
    for low, high, shift in hits:
        one, apart = [low, high, shift, shift], []
        for r in near:
            if r[1] + slack < low:
                done.append(r)
            elif r[2] - 16 <= shift <= r[3] + 16:
                one = [min(r[0], one[0]), max(r[1], one[1]), min(r[2], one[2]), max(r[3], one[3])]
            else:
                apart.append(r)
        near = [*apart, one]
    return done + near


def joined(group: np.ndarray, low: np.ndarray, high: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, low, high) of intervals of one group, joined where they overlap or lie at most ``slack`` apart."""
    order = np.lexsort((low, group))
    group, low, high = group[order], low[order], high[order]
    if not len(low):
        return group, low, high
    new = np.concatenate([[True], group[1:] != group[:-1]])
    lift = (np.cumsum(new) - 1) * (int(high.max()) + slack + 2)
    reach = np.maximum.accumulate(high + lift)
    new[1:] |= low[1:] + lift[1:] > reach[:-1] + slack
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    return group[first], low[first], reach[last] - lift[last]


def own_repeats(token: np.ndarray, text: np.ndarray, found: tuple[np.ndarray, ...], again: np.ndarray, min_words: int, percent: int) -> tuple[np.ndarray, ...]:
    """(text, first and last shingle place) of verified passages that a text repeats itself, and which windows of ``again``
    they confirm: windows whose key their text had before, at the window in front of them.
    """
    l, c, d, r = found
    before = again - 1
    shift = c[again] - c[before]
    low, high = np.maximum(l[before], l[again] - shift), np.minimum(r[before], r[again] - shift)
    apart = shift > 0
    # collisions of one shift first, as in a text that repeats a line; then those of like shifts
    group, low, high = joined((text[again][apart] << 32) | shift[apart], low[apart], high[apart], 8)
    who, shift = group >> 32, group & 0xFFFFFFFF
    order = np.lexsort((shift, high, low, who))
    who, rows = who[order], np.stack([low[order], high[order], shift[order]], 1)
    cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1], [True]])) if len(who) else np.zeros(1, np.int64)
    out: list[tuple[int, int, int]] = []
    met = np.zeros(len(again), bool)
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        of = slice(*np.searchsorted(text[again], [who[x], who[x] + 1]))
        u, v = before[of], again[of]
        for lo, hi, s1, s2 in stretches([tuple(h) for h in rows[x:y].tolist()]):
            for x1, x2, y1, y2 in passages(token[lo : hi + 1], token[lo + s1 : hi + s2 + 1], min_words, percent, s1):
                x1, x2, y1, y2 = lo + x1, lo + x2, lo + s1 + y1, lo + s1 + y2
                out += [(int(who[x]), x1, x2), (int(who[x]), y1, y2)]
                met[of] |= (x1 <= c[u]) & (d[u] <= x2) & (y1 <= c[v]) & (d[v] <= y2)
    return *joined(*np.array(out, np.int64).reshape(-1, 3).T, 0), met


def all_windows(texts: DataFrame, pairs: int, width: int, min_words: int, percent: int) -> DataFrame:
    """key, t (name of the text), m (first c << 32 | last c), w (l << 32 | r), own (false) for the windows under all pairs
    of hashes; and the word spans that a text repeats itself: t, m (start), w (end), own (true), under any key.

    A pair of smallest tokens stands for subsequences of just ``width`` tokens that hold both: a longer passage has such
    parts. Windows of one key in one text meet here, each the one before it. One that a verified passage links to the one
    before it goes, since the first of them stands for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name = b.column("t").to_numpy()
            for start, _, t in Texts.chunks(b.column("text")):
                token, at = _tokens(t)
                all_of: list[tuple[np.ndarray, ...]] = []
                for i in range(pairs):
                    x, y = (mix(token ^ mix(np.full(1, 2 * i + j + 1, U64))) for j in (0, 1))
                    one, two = windows(x, at, width), windows(y, at, width)
                    u, v, low, begin, end, high = crossed(one, two, width)
                    key = mix(mix(x[one[1][u]] + U64(i)) * U64(0x9E3779B97F4A7C15) + y[two[1][v]])
                    all_of.append((key, low, begin, end, high))
                key, *found = (np.concatenate(z) for z in zip(*all_of, strict=True))
                text = np.searchsorted(at, found[1], "right") - 1
                order = np.lexsort((found[2], found[1], key, text))
                key, text, found = key[order], text[order], [z[order] for z in found]
                same = np.concatenate([np.zeros(min(1, len(key)), bool), (key[1:] == key[:-1]) & (text[1:] == text[:-1])])
                again = np.flatnonzero(same)
                who, lo, hi, met = own_repeats(token, text, tuple(found), again, min_words, percent)
                keep = np.ones(len(key), bool)
                keep[again[met]] = False
                # places within the text, which has less than 2^31 bytes
                l, c, d, r = ((z - at[text])[keep] for z in found)
                columns = [
                    np.concatenate([key[keep].view(np.int64), mix(lo.astype(U64)).view(np.int64)]), name[np.concatenate([text[keep], who]) + start],
                    np.concatenate([(c << 32) | d, lo - at[who]]), np.concatenate([(l << 32) | r, hi + SHINGLE - at[who]]), np.repeat([False, True], [len(c), len(who)]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in columns], ["key", "t", "m", "w", "own"])

    return texts.select("t", "text").mapInArrow(run, "key bigint, t bigint, m bigint, w bigint, own boolean")


def colliding(found: DataFrame) -> DataFrame:
    """The windows of keys that have another one, too, and what texts repeat themselves. Copies of a text have the same
    windows: a key that nothing else has is no collision. One of each stays, or one a batch that a key goes through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "t", "m", "w", "own"]
        # the last key: one of its windows, and whether it is known to collide and was put out
        held, known = np.zeros((5, 0), np.int64), False
        for b in batches:
            now = np.stack([b.column(x).to_numpy(zero_copy_only=x != "own").astype(np.int64) for x in names])
            row = np.concatenate([held, now], 1)
            if not row.shape[1]:
                continue
            key, t, m, _, own = row
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            other = np.logical_or.reduceat((t != t[first][of]) | (m != m[first][of]), first)
            other[0] |= known
            keep = other[of] | (own > 0)
            # what was held is out already where its key was known to collide or where it is no window
            skip = held.shape[1] and (known or own[0] > 0)
            keep[0] &= not skip
            held, known = row[:, first[-1] : first[-1] + 1], bool(other[-1])
            out = row[:, keep]
            if out.shape[1]:
                out = out[:, np.lexsort(out[:4])]
                out = out[:, np.concatenate([[True], (out[:, 1:] != out[:, :-1]).any(0)])]
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in (*out[:4], out[4] > 0)], names)

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, t bigint, m bigint, w bigint, own boolean")


def word_counts(texts: DataFrame) -> DataFrame:
    """doc_id, t, n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in Texts.chunks(b.column("text")):
                begins = NON_SPACE[t.data]
                follows = np.concatenate([[False], begins[:-1]])
                follows[t.at[:-1][t.at[:-1] < len(follows)]] = False
                n = np.diff(np.concatenate([[0], np.cumsum(begins & ~follows)])[t.at])
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], b.column("t")[lo:hi], pa.array(n)], ["doc_id", "t", "n_words"])

    return texts.select("doc_id", "t", "text").mapInArrow(run, "doc_id bigint, t bigint, n_words bigint")


def _regions(pairs: DataFrame, slack: int = 8) -> DataFrame:
    """a, b, and the regions of both that overlapping collisions of a pair cover (shingle places, ends included)."""

    def found(field: np.ndarray) -> pa.RecordBatch:
        a, b, ma, wa, mb, wb = field
        (l1, r1), (l2, r2) = ((w >> 32, w & 0xFFFFFFFF) for w in (wa, wb))
        shift = (mb >> 32) - (ma >> 32)
        # what both windows cover, once their smallest tokens stand on each other, and a little more
        low, high = np.maximum(l1, l2 - shift), np.minimum(r1, r2 - shift)
        group = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        order = np.lexsort((shift, high, low, group))
        hits = np.stack([group, low, high, shift])[:, order]
        hits = hits[:, np.concatenate([[True], (hits[:, 1:] != hits[:, :-1]).any(0)]) & ((a != b)[order] | (hits[3] != 0))]
        first = np.searchsorted(group, hits[0])
        cut = np.flatnonzero(np.concatenate([[True], hits[0, 1:] != hits[0, :-1], [True]])) if hits.shape[1] else np.zeros(1, np.int64)
        alone = np.diff(cut) == 1
        one = cut[:-1][alone]
        out = [np.stack([first[one], hits[1, one], hits[2, one], hits[3, one], hits[3, one]], 1)]
        for x, y in zip(cut[:-1][~alone].tolist(), cut[1:][~alone].tolist(), strict=True):
            out.append(np.array([(first[x], *r) for r in stretches([tuple(h) for h in hits[1:, x:y].T.tolist()], slack)]))
        at, lo, hi, s1, s2 = np.concatenate(out).T
        columns = (a[at], b[at], np.maximum(0, lo), hi, np.maximum(0, lo + s1), hi + s2)
        return pa.RecordBatch.from_arrays([pa.array(z) for z in columns], ["a", "b", "a1", "a2", "b1", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.zeros((6, 0), np.int64)
        for batch in batches:
            field = np.concatenate([open_, np.stack([batch.column(c).to_numpy() for c in ("a", "b", "ma", "wa", "mb", "wb")])], 1)
            if not field.shape[1]:
                continue
            # the last pair of texts may go on in the next batch
            last = int(np.flatnonzero((field[:2] != field[:2, -1:]).any(0)).max(initial=-1)) + 1
            open_ = field[:, last:]
            if last:
                yield found(field[:, :last])
        if open_.shape[1]:
            yield found(open_)

    each = pairs.select("a", "b", "ma", "wa", "mb", "wb").repartition("a", "b").sortWithinPartitions("a", "b")
    return each.mapInArrow(run, "a bigint, b bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint")


def _bodies(texts: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """t, text: the texts that ``members`` name, each once. A text's bytes come from its first document."""
    named = members.select("t").distinct().join(classes.select("t", "rep"), "t")
    found = texts.join(named.hint("shuffle_hash"), "t").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    return found.select("t", "text").dropDuplicates(["t"])


def _slices(bodies: DataFrame, places: DataFrame) -> DataFrame:
    """places: t, lo, hi (shingle places) -> t, lo, hi, words (the region's text). A leader's region is cut once, however many
    texts are compared with it.
    """
    each = places.groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, name = b.column("s"), b.column("t").to_pylist()
            for lo, hi, t in Texts.chunks(b.column("text")):
                w = t.words(NON_SPACE)
                raw = t.data.tobytes()
                out: dict[str, list] = {k: [] for k in ("t", "lo", "hi", "words")}
                for i in range(hi - lo):
                    first, count = w.at[i], w.at[i + 1] - w.at[i]
                    for s in column[lo + i].as_py():
                        x, y = s["lo"], min(count, s["hi"] + SHINGLE)
                        if x < y:
                            out["t"].append(name[lo + i]), out["lo"].append(x), out["hi"].append(s["hi"])
                            out["words"].append(raw[w.start[first + x] : w.end[first + y - 1]].decode())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return bodies.join(each.hint("shuffle_hash"), "t").select("t", "text", "s").mapInArrow(run, "t bigint, lo bigint, hi bigint, words string")


def alike(m: np.ndarray, q: np.ndarray, min_words: int, percent: int) -> list[tuple[int, int]]:
    """Stretches [i, j] of places in the first array (m) that equal places in the second (q), where no shingle is repeated:
    all that lies in some passage, passages joined that overlap.

    From match i to match j both arrays have j - i + 1 shingles in common, of m[j] - m[i] + 1 and q[j] - q[i] + 1. That this
    is enough means that a sum over the matches is no smaller at j than at i, so that the last such j is found by bisection.
    """
    out: list[tuple[int, int]] = []
    pieces = np.concatenate([[0], np.flatnonzero(np.diff(q) <= 0) + 1, [len(m)]])
    for a, z in zip(pieces[:-1].tolist(), pieces[1:].tolist(), strict=True):
        x, y = m[a:z], q[a:z]
        if min(x[-1] - x[0], y[-1] - y[0]) + SHINGLE < min_words:
            continue
        f = (100 + percent) * np.arange(z - a) - percent * (x + y)
        ahead = np.maximum.accumulate(f[::-1])
        j = z - a - 1 - np.searchsorted(ahead, f - 100 + percent)
        i = np.flatnonzero((j >= np.arange(z - a)) & (np.minimum(x[j] - x, y[j] - y) + SHINGLE >= min_words))
        if len(i):
            reach = np.maximum.accumulate(j[i])
            new = np.concatenate([[True], i[1:] > reach[:-1]])
            ends = np.append(np.flatnonzero(new)[1:], len(i)) - 1
            out += list(zip((a + i[new]).tolist(), (a + reach[ends]).tolist(), strict=True))
    return out


def passages(x: np.ndarray, y: np.ndarray, min_words: int, percent: int, apart: int | None = None) -> list[tuple[int, int, int, int]]:
    """Verified passages of two shingle arrays: places [x1, x2] and [y1, y2], ends included. ``apart``: of two regions of
    one text, how far the second begins after the first; a place is no repeat of itself. Matches that stand near each other
    are a passage as a whole, or the parts of them that are.
    """
    found: list[tuple[int, int, int, int]] = []
    common = np.intersect1d(x, y)
    if not len(common):
        return found
    match, there = np.flatnonzero(np.isin(x, common)), np.flatnonzero(np.isin(y, common))
    # the regions begin side by side: of a token's places in y, the one nearest to its place in x
    held = np.sort((np.searchsorted(common, y[there]) << 32) | there)
    want = (np.searchsorted(common, x[match]) << 32) | match
    after = np.searchsorted(held, want)
    at = after[:, None] + np.arange(-2, 2)
    near = held[np.clip(at, 0, len(held) - 1)]
    far = np.where(near >> 32 == (want >> 32)[:, None], np.abs(near - want[:, None]), 1 << 40)
    near &= 0xFFFFFFFF
    if apart is not None:
        far[near + apart == match[:, None]] = 1 << 40
    best = np.argmin(far, 1)[:, None]
    in_y, other = np.take_along_axis(near, best, 1)[:, 0], np.take_along_axis(far, best, 1)[:, 0] < 1 << 40
    match, in_y = match[other], in_y[other]
    free = np.ones(len(match), bool)
    for gap in (12, 6, 2, 0):
        left = np.flatnonzero(free)
        if not len(left):
            break
        m, q = match[left], in_y[left]
        cut = np.flatnonzero((np.diff(m) > gap + 1) | (np.abs(np.diff(q) - np.diff(m)) > gap + 16)) + 1
        for part in np.split(np.arange(len(left)), cut):
            x1, x2, y1, y2 = m[part[0]], m[part[-1]], q[part].min(), q[part].max()
            if min(x2 - x1, y2 - y1) + SHINGLE < min_words:
                continue
            sx, sy = np.unique(x[x1 : x2 + 1]), np.unique(y[y1 : y2 + 1])
            both = len(np.intersect1d(sx, sy, assume_unique=True))
            if 100 * both >= percent * (len(sx) + len(sy) - both):
                found.append((int(x1), int(x2), int(y1), int(y2)))
                free[left[part]] = False
            elif gap == 12 and len(sx) == x2 - x1 + 1 and len(sy) == y2 - y1 + 1:
                for i, j in alike(m[part], q[part], min_words, percent):
                    found.append((int(m[part[i]]), int(m[part[j]]), int(q[part[i]]), int(q[part[j]])))
                    free[left[part[i : j + 1]]] = False
    return found


def plain_passages(match: np.ndarray, in_y: np.ndarray, min_words: int, percent: int) -> list[tuple[int, int, int, int]]:
    """``passages`` of two arrays that repeat no shingle: those at ``match`` of the first stand at ``in_y`` of the second."""
    found: list[tuple[int, int, int, int]] = []
    m, q = match, in_y
    for gap in (12, 6, 2, 0):
        step = np.diff(m)
        cut = np.flatnonzero((step > gap + 1) | (np.abs(np.diff(q) - step) > gap + 16)) + 1
        first, last = np.concatenate([[0], cut]), np.append(cut, len(m)) - 1
        free = np.ones(len(m), bool)
        for i in np.flatnonzero(m[last] - m[first] + SHINGLE >= min_words).tolist():
            part = slice(first[i], last[i] + 1)
            x1, x2, y1, y2 = int(m[first[i]]), int(m[last[i]]), int(q[part].min()), int(q[part].max())
            if y2 - y1 + SHINGLE < min_words:
                continue
            inside = in_y[slice(*np.searchsorted(match, [x1, x2 + 1]))]
            both = np.count_nonzero((inside >= y1) & (inside <= y2))
            if 100 * both >= percent * (x2 - x1 + y2 - y1 + 2 - both):
                found.append((x1, x2, y1, y2))
                free[part] = False
            elif gap == 12:
                for u, v in alike(m[part], q[part], min_words, percent):
                    found.append((int(m[part][u]), int(m[part][v]), int(q[part][u]), int(q[part][v])))
                    free[part][u : v + 1] = False
        # where places go up, ``alike`` has found what parts with less between them have
        if gap == 12 and (np.diff(q) > 0).all():
            break
        m, q = m[free], q[free]
        if not len(m):
            break
    return found


#: Words of both sides that a task has as tokens at once.
PART_BYTES = 16 << 20


def compared(one: pa.Array, two: pa.Array, shift: np.ndarray, same: np.ndarray, min_words: int, percent: int) -> np.ndarray:
    """(row, x1, x2, y1, y2) of the passages of rows of words. Equal words are tokens once, however many rows have them."""
    sides, token, at = [one.dictionary_encode(), two.dictionary_encode()], [], [np.zeros(1, np.int64)]
    for side in sides:
        for _, _, t in Texts.chunks(side.dictionary):
            h, ends = _tokens(t)
            token.append(h), at.append(ends[1:] + at[-1][-1])
    names, token = np.unique(np.concatenate(token), return_inverse=True)
    at = np.concatenate(at)
    own = [token[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    there = np.full(len(names), -1, np.int32)
    plain = np.zeros(len(own), bool)
    place = np.arange(max(map(len, own)), dtype=np.int32)
    for i, z in enumerate(own):
        there[z] = place[: len(z)]
        plain[i] = (there[z] == place[: len(z)]).all()
    there[:] = -1
    i, j = sides[0].indices.to_numpy(), sides[1].indices.to_numpy() + len(sides[0].dictionary)
    out: list[tuple[int, ...]] = []
    set_to = -1
    for row in np.argsort(j, kind="stable").tolist():
        x, y = own[i[row]], own[j[row]]
        if min(len(x), len(y)) + SHINGLE - 1 < min_words:
            continue
        if same[row] or not (plain[i[row]] and plain[j[row]]):
            out += [(row, *p) for p in passages(x, y, min_words, percent, int(shift[row]) if same[row] else None)]
            continue
        if set_to != j[row]:
            if set_to >= 0:
                there[own[set_to]] = -1
            there[y] = place[: len(y)]
            set_to = j[row]
        in_y = there[x]
        match = np.flatnonzero(in_y >= 0)
        if len(match) and match[-1] - match[0] + SHINGLE >= min_words:
            out += [(row, *p) for p in plain_passages(match, in_y[match].astype(np.int64), min_words, percent)]
    return np.array(out, np.int64).reshape(-1, 5)


def _verify(regions: DataFrame, slices: DataFrame, min_words: int, percent: int) -> DataFrame:
    """a, b, and the word spans [a1, a2) and [b1, b2) of verified passages."""
    side = lambda x, s: slices.select(F.col("t").alias(x), F.col("lo").alias(f"{x}1"), F.col("hi").alias(f"{x}2"), F.col("words").alias(f"words{s}"))
    both = regions.join(side("a", 0), ["a", "a1", "a2"]).join(side("b", 1), ["b", "b1", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = sum(pc.binary_length(whole.column(f"words{s}")).to_numpy().astype(np.int64) for s in (0, 1))
            part = np.cumsum(size) // PART_BYTES
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                b = whole.slice(x, y - x)
                names = [b.column(c).to_numpy() for c in ("a", "b", "a1", "b1")]
                at, *place = compared(b.column("words0"), b.column("words1"), names[3] - names[2], names[0] == names[1], min_words, percent).T
                u, v, lo0, lo1 = (z[at] for z in names)
                columns = (u, v, lo0 + place[0], lo0 + place[1] + SHINGLE, lo1 + place[2], lo1 + place[3] + SHINGLE)
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in columns], ["a", "b", "a1", "a2", "b1", "b2"])

    return both.select("a", "b", "a1", "b1", "words0", "words1").mapInArrow(run, "a bigint, b bigint, a1 bigint, a2 bigint, b1 bigint, b2 bigint")


SPANS = "struct<lo:bigint,hi:bigint>"


def merged(spans: Column) -> Column:
    """Sorted spans, joined where they touch."""
    none = F.array().cast(f"array<{SPANS}>")

    def step(a: Column, s: Column) -> tuple[Column, Column]:
        apart = a.isNull() | (s["lo"] > a["hi"])
        wider = F.struct(a["lo"].alias("lo"), F.greatest(a["hi"], s["hi"]).alias("hi"))
        return F.when(apart, s).otherwise(wider), F.when(apart & a.isNotNull(), F.array(a)).otherwise(none)

    return scan(spans, F.lit(None).cast(SPANS), SPANS, SPANS, step, lambda a: F.when(a.isNull(), none).otherwise(F.array(a)))


def open_windows(members: DataFrame, spans: DataFrame | None) -> DataFrame:
    """``members`` with ``open``: whether the smallest tokens lie inside none of their text's confirmed spans (t, lo, hi)."""
    if spans is None:
        return members.withColumn("open", F.lit(True))
    done = spans.groupBy("t").agg(merged(F.array_sort(F.collect_set(F.struct("lo", "hi")))).alias("s"))
    first, last = F.shiftright("m", 32), F.col("m").bitwiseAND(F.lit(0xFFFFFFFF))
    inside = F.exists("s", lambda s: (s["lo"] <= first) & (last + SHINGLE <= s["hi"]))
    return members.join(done, "t", "left").withColumn("open", ~F.coalesce(inside, F.lit(False))).drop("s")


#: A sketch has a bit of 64 for each of so many tokens. Windows meet in the last passes where a pair of sketches has this many bits in common.
SKETCH, COMMON = 22, 11


def sketched(token: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token, the bits of the ``SKETCH`` tokens that end with it and of those that begin with it, within its text."""
    # nothing between texts, as long as a sketch
    place = np.arange(len(token)) + SKETCH * np.repeat(np.arange(1, len(at)), np.diff(at))
    run, size = np.zeros(len(token) + SKETCH * len(at), U64), 1
    run[place] = U64(1) << (mix(token) >> U64(58))
    while size < SKETCH:
        step = min(size, SKETCH - size)
        run, size = run[:-step] | run[step:], size + step
    return run[place - SKETCH + 1], run[place]


#: Pairs of windows of one key that are looked at, and judged, at once.
PAIRS, JUDGED = 1 << 20, 2048
#: A token of a context is a hash of 12 bits; OUTSIDE stands for none, and AGAIN marks a token that the context may have before.
OUTSIDE, AGAIN = 1 << 12, 1 << 13


def contexts(token: np.ndarray, at: np.ndarray, of: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each place ``first`` of text ``of``: the ``width`` + 4 tokens before it, backwards, and 2 ``width`` + 4 from it on."""
    step = np.concatenate([-1 - np.arange(width + 4), np.arange(2 * width + 4)])
    short = (mix(token) >> U64(52)).astype(np.uint16)
    # the hash's upper bits, then the place: one that is taken for a repeat counts for less
    size = U64(len(token).bit_length())
    order = np.sort((mix(token) >> size << size) | np.arange(len(token), dtype=U64))
    place = (order & ((U64(1) << size) - U64(1))).astype(np.int64)
    short[place[1:][(order[1:] >> size == order[:-1] >> size) & (np.diff(place) < len(step))]] |= AGAIN
    out = np.full((len(of), len(step)), OUTSIDE, np.uint16)
    for x in range(0, len(of), 4096):
        begin, end = at[of[x : x + 4096], None], at[of[x : x + 4096] + 1, None]
        place = begin + first[x : x + 4096, None] + step
        np.copyto(out[x : x + 4096], short.take(place, mode="clip"), where=(begin <= place) & (place < end))
    return out


def balance(near: np.ndarray, span: np.ndarray, i: np.ndarray, j: np.ndarray, width: int, min_words: int, percent: int) -> np.ndarray:
    """How well a stretch of context ``i`` could be its side of a passage with context ``j``: at best, among those that hold the
    smallest tokens and have ``min_words`` words. A token that the other context has, too, counts for it, others count
    against it, such that the two sides of a passage come to 0 or more together.
    """
    good, bad = 100 - percent, 2 * percent
    good, bad = (np.int16(z // np.gcd(good, bad)) for z in (good, bad))
    mine, of = np.unique(i, return_inverse=True)
    other, row = np.unique(j, return_inverse=True)
    there = np.zeros((len(other), OUTSIDE + 1), bool)
    there[np.arange(len(other))[:, None], near[other] & (AGAIN - 1)] = True
    there[:, OUTSIDE] = False
    own = near[mine]
    # a token repeated counts once in a set
    alone = np.where(own == OUTSIDE, np.int16(-(1 << 14)), np.where(own & AGAIN, np.int16(0), -bad))
    found = there.ravel().take((own & (AGAIN - 1)).astype(np.int32)[of] + (row * (OUTSIDE + 1)).astype(np.int32)[:, None])
    value = np.where(found, good, alone[of])
    left = width + 4
    back = np.zeros((len(i), left + 1), np.int32)
    np.cumsum(value[:, :left], axis=1, dtype=np.int32, out=back[:, 1:])
    ahead = np.cumsum(value[:, left:], axis=1, dtype=np.int32)
    ahead[np.arange(ahead.shape[1]) < span[i][:, None]] = -(1 << 28)
    ahead = np.maximum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1]
    # with so many tokens in front of the place, as many from it on as make ``min_words`` words
    back += ahead[:, np.maximum(0, min_words - SHINGLE - np.arange(left + 1))]
    return back.max(1)


def near_pairs(row: np.ndarray, near: np.ndarray, width: int, min_words: int, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, balance) of the windows of one key, one of them open, that could lie in a passage of both by their contexts.

    row: key, t, m, w, open, back, ahead; by key.
    """
    key, t, m, _, opened = row[:5]
    back, ahead = row[5].view(U64), row[6].view(U64)
    opened, span = opened > 0, (m & 0xFFFFFFFF) - (m >> 32)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.append(first, len(key)))
    group = np.repeat(np.arange(len(first)), many)
    who = np.flatnonzero(opened & (many[group] > 1))
    total = np.cumsum(many[group[who]])
    at = 0
    while at < len(who):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = many[group[who[at:to]]]
        i = np.repeat(who[at:to], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first[group[who[at:to]]], n)
        at = to
        on = (~opened[j] | (i < j)) & ((t[i] != t[j]) | (m[i] != m[j]))
        i, j = i[on], j[on]
        on = (np.bitwise_count(back[i] & back[j]) >= COMMON) | (np.bitwise_count(ahead[i] & ahead[j]) >= COMMON)
        # few contexts at a time meet each other
        order = np.flatnonzero(on)[np.lexsort((j[on] // 64, i[on] // 64))]
        i, j = i[order], j[order]
        score = np.zeros(len(i), np.int64)
        for x in range(0, len(i), JUDGED):
            u, v = i[x : x + JUDGED], j[x : x + JUDGED]
            score[x : x + JUDGED] = balance(near, span, u, v, width, min_words, percent) + balance(near, span, v, u, width, min_words, percent)
        yield i[score >= 0], j[score >= 0], score[score >= 0]


CONTEXT = "key bigint, t bigint, m bigint, w bigint, open boolean, back bigint, ahead bigint, near binary"


def _contexts(bodies: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` (key, t, m, w, open) with the sketches of the tokens up to the last smallest one and from the first one on
    (back, ahead), and the context.
    """
    each = members.groupBy("t").agg(F.collect_list(F.struct("key", "m", "w", "open")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, name = b.column("s"), b.column("t").to_numpy()
            ends = column.offsets.to_numpy()
            for lo, hi, t in Texts.chunks(b.column("text")):
                token, at = _tokens(t)
                back, ahead = sketched(token, at)
                each = column.values.slice(ends[lo], ends[hi] - ends[lo])
                all_of = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                for x in range(0, len(all_of), 1 << 14):
                    some, of = each.slice(x, 1 << 14), all_of[x : x + (1 << 14)]
                    m = some.field("m").to_numpy()
                    data = contexts(token, at, of, m >> 32, width)
                    place = pa.py_buffer(np.arange(len(of) + 1, dtype=np.int32) * data.shape[1] * 2)
                    near = pa.Array.from_buffers(pa.binary(), len(of), [None, place, pa.py_buffer(data)])
                    sides = (back[at[of] + (m & 0xFFFFFFFF)], ahead[at[of] + (m >> 32)])
                    columns = [some.field("key"), name[lo + of], m, some.field("w"), some.field("open"), *(z.view(np.int64) for z in sides), near]
                    yield pa.RecordBatch.from_arrays([pa.array(z) if isinstance(z, np.ndarray) else z for z in columns], [c.split()[0] for c in CONTEXT.split(", ")])

    return bodies.join(each.hint("shuffle_hash"), "t").select("t", "text", "s").mapInArrow(run, CONTEXT)


def _judged(members: DataFrame, width: int, min_words: int, percent: int, best: bool) -> DataFrame:
    """Windows of one key, one of them open, that could lie in a passage of both: t, m, w (widened to the context) of either, and
    ``more``. ``best``: for each open window the best one alone, and whether it has ``more``.
    """
    numbers = ["key", "t", "m", "w", "open", "back", "ahead"]
    names = ["key", "t", "m", "w", "t2", "m2", "w2", "more"]

    def found(row: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort(row[2::-1])
        order = order[np.concatenate([[True], (row[:3, order[1:]] != row[:3, order[:-1]]).any(0)])]
        row, data = row[:, order], data[order]
        # a passage may go beyond the windows: all of the contexts is compared
        c, w = row[2] >> 32, row[3]
        row[3] = np.minimum(w >> 32, np.maximum(0, c - width - 4)) << 32 | np.maximum(w & 0xFFFFFFFF, c + 2 * width + 3)
        out = lambda i, j, more: pa.RecordBatch.from_arrays([pa.array(z) for z in (*row[:4, i], *row[1:4, j], more)], names)
        top, with_, many = np.full(len(order), -1), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for i, j, score in near_pairs(row, data, width, min_words, percent):
            if not best:
                if len(i):
                    yield out(i, j, np.ones(len(i), bool))
                continue
            i, j, score = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([score, score])
            many += np.bincount(i, minlength=len(many))
            by = np.lexsort((j, score, i))
            by = by[np.append(i[by][1:] != i[by][:-1], True)] if len(by) else by
            by = by[score[by] > top[i[by]]]
            top[i[by]], with_[i[by]] = score[by], j[by]
        if best and len(i := np.flatnonzero((many > 0) & (row[4] > 0))):
            yield out(i, with_[i], many[i] > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of the last key, which may go on in the next batch
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not len(b):
                continue
            row = np.stack([b.column(x).to_numpy(zero_copy_only=x != "open").astype(np.int64) for x in numbers])
            column = b.column("near")
            data = np.frombuffer(column.buffers()[2], np.uint16)[: len(b) * (3 * width + 8) + column.offset * (3 * width + 8)].reshape(-1, 3 * width + 8)[column.offset :]
            cut = int(np.searchsorted(row[0], row[0, -1]))
            if cut or (held and held[0][0][0, 0] != row[0, 0]):
                ready = [*held, (row[:, :cut], data[:cut])]
                held = []
                yield from found(*(np.concatenate(z, axis) for z, axis in zip(zip(*ready, strict=True), (1, 0), strict=True)))
            held.append((row[:, cut:], data[cut:]))
        if held:
            yield from found(*(np.concatenate(z, axis) for z, axis in zip(zip(*held, strict=True), (1, 0), strict=True)))

    kind = "key bigint, t bigint, m bigint, w bigint, t2 bigint, m2 bigint, w2 bigint, more boolean"
    return members.repartition("key").sortWithinPartitions("key").mapInArrow(run, kind)


def near_passages(docs: DataFrame, min_words: int = 50, percent: int = 80, pairs: int = 4, rounds: int = 2) -> DataFrame:
    """A row for each document that has a passage found elsewhere: doc_id, n_words, n_repeated (words), spans
    (``start:end`` word places, comma-joined), copies (documents with this very text, itself included), like_id (the
    least id of a text that has such a passage).
    """
    spark = docs.sparkSession
    width = max(2, min_words - SHINGLE + 1 - 2)
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    classes = materialize(named.groupBy("t").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep")))
    found = all_windows(named, pairs, width, min_words, percent)
    several = materialize(colliding(found))
    let_go(spark)
    members, own = several.where("NOT own").drop("own"), several.where("own")
    bodies = materialize(_bodies(named, classes, members))
    let_go(spark)
    tables, seen, judged, spans = [several, bodies], None, None, own.select("t", F.col("t").alias("other"), F.col("m").alias("lo"), F.col("w").alias("hi"))
    for turn in range(rounds + 2):
        # whatever a text repeats itself, its windows meet those of others once
        now = open_windows(members, spans if turn else None) if turn <= rounds else None
        if turn < rounds:
            # by the text's hash, then the first place (27 bits) and how far the last one is from it: numbers, which Spark hashes
            first, last = F.shiftright("m", 32), F.col("m").bitwiseAND(F.lit(0xFFFFFFFF))
            rank = F.shiftleft(F.shiftright(F.xxhash64("t", F.lit(turn)), 33), 33) + F.shiftleft(first, 6) + F.least(last - first, F.lit(63))
            lead = now.where("open").groupBy("key").agg(*[F.min_by(x, rank).alias(f"{x}2") for x in ("t", "m", "w")])
            met = members.join(lead, "key").where("t <> t2 OR m <> m2")
        else:
            # what no leader confirmed meets that one of the other windows of its key with which it could best lie in a passage;
            # then what is still open meets all with which it could
            if turn == rounds:
                now = now.withColumn("some", F.max("open").over(Window.partitionBy("key"))).where("some").drop("some")
                near = materialize(_contexts(bodies, now, width))
                let_go(spark)
                met = judged = materialize(_judged(near, width, min_words, percent, best=True))
                let_go(spark)
            else:
                left = open_windows(judged.where("more").select("key", "t", "m"), spans).where("open")
                now = near.drop("open").join(left, ["key", "t", "m"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
                met = _judged(now.join(left.select("key").distinct(), "key", "left_semi"), width, min_words, percent, best=False)
        # a pair of texts has one order, whoever leads
        two = F.struct("t", "m", "w"), F.struct(F.col("t2").alias("t"), F.col("m2").alias("m"), F.col("w2").alias("w"))
        met = met.select(F.least(*two).alias("one"), F.greatest(*two).alias("two"))
        regions = _regions(met.select(F.col("one.t").alias("a"), F.col("one.m").alias("ma"), F.col("one.w").alias("wa"), F.col("two.t").alias("b"), F.col("two.m").alias("mb"), F.col("two.w").alias("wb")))
        if seen is not None:
            regions = regions.join(seen, ["a", "b", "a1", "a2", "b1", "b2"], "left_anti")
        regions = materialize(regions)
        let_go(spark)
        seen = regions if seen is None else seen.unionByName(regions)
        side = lambda x: regions.select(F.col(x).alias("t"), F.col(f"{x}1").alias("lo"), F.col(f"{x}2").alias("hi"))
        slices = materialize(_slices(bodies, side("a").unionByName(side("b"))))
        good = materialize(_verify(regions, slices, min_words, percent))
        tables += [regions, good]
        forget(slices)
        let_go(spark)
        both = good.select(F.col("a").alias("t"), F.col("b").alias("other"), F.col("a1").alias("lo"), F.col("a2").alias("hi")).unionByName(
            good.select(F.col("b").alias("t"), F.col("a").alias("other"), F.col("b1").alias("lo"), F.col("b2").alias("hi"))
        )
        spans = spans.unionByName(both)
    other = spans.join(classes.select(F.col("t").alias("other"), F.col("rep").alias("like")), "other")
    by_text = other.groupBy("t").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("s"), F.min("like").alias("like"))
    by_text = materialize(by_text.select("t", merged(F.col("s")).alias("s"), "like"))
    forget(near, judged, *tables)
    let_go(spark)
    sized = word_counts(named).join(classes, "t").join(by_text, "t", "left")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= min_words)
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.col("n_words").alias("hi")))
    marked = sized.withColumn("s", F.when(copied, whole).otherwise(F.col("s"))).where(F.size("s") > 0)
    return marked.select(
        "doc_id", "n_words",
        F.aggregate("s", F.lit(0).cast("bigint"), lambda a, s: a + s["hi"] - s["lo"]).alias("n_repeated"),
        F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["lo"], s["hi"])), ",").alias("spans"),
        "copies", F.when(copied, F.least("rep", "like")).otherwise(F.col("like")).alias("like_id"),
    )
