"""Suffix-array deduplication: bytes of strings of `LENGTH` that also start elsewhere are removed.

Every window of LENGTH bytes names an anchor, the place of its least 32-byte hash, and the half of
the window that lies before or after it and is the longer one. Equal windows name equal halves.
Neighbouring windows that name the same half of one anchor make a segment, and a string that starts
twice lies in two segments whose halves have one hash, the segments' anchor hash. Segments whose
anchor hash is unique in the corpus go no further. Of the rest, those whose whole content is found again are repeated as a whole, and
one of each content stands for all. Contents that share an anchor hash and differ, at the ends of
copied passages, are gathered in shards by that hash, each shard gets a suffix array by induced sorting, and
permuted common prefixes of LENGTH or more give the windows that are repeated.

Passages of `WORDS` words that stand in other documents too are told in the same passes, with words in
the place of bytes: they may be shorter than LENGTH, so they are counted and not removed.

An anchor hash with more contents than `HOT_CONTENTS` would make a shard grow with the corpus; its
windows are counted by their own hashes instead, which is as exact and spreads over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import jaccard
from quernel.llm.common import byte_chunks, cut, drop, release

LENGTH = 400
GRAM = 32
SHARD_BYTES = 1 << 20
HOT_CONTENTS = 3000
#: Words of a passage that is reported, the strings of words that its anchor is chosen among, and half a passage.
WORDS = 51
WORD_GRAM = 8
HALF_WORDS = 25
CHUNK = 1 << 18
_PLACE_BITS = 26


# --- suffix arrays -------------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; the last is one."""
    n = len(s)
    rises, differs = s[:-1] < s[1:], s[:-1] != s[1:]
    nearest = np.where(differs, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    return np.append(np.append(rises, True)[nearest], True)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """The order of all suffixes that the order of the leftmost-smaller ones induces.

    Buckets are filled from the least letter up for L-types and from the greatest down for S-types.
    A bucket's entries induce together, wave by wave: only a run of one letter refers to its own bucket.
    """
    n = len(s)
    counts = np.bincount(s, minlength=letters)
    ends = np.cumsum(counts)
    heads = ends - counts
    n_large = np.bincount(s[~small], minlength=letters)
    out = np.full(n, -1, np.int64)
    by = lms[np.argsort(s[lms], kind="stable")]
    lms_ends = np.cumsum(np.bincount(s[lms], minlength=letters))
    fill = heads.copy()

    def put(sources: np.ndarray, large: bool) -> None:
        at = sources[sources > 0] - 1
        at = at[~small[at]] if large else at[small[at]]
        if not len(at):
            return
        c = s[at]
        order = np.argsort(c, kind="stable")
        c, at = c[order], at[order]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        sizes = np.diff(np.append(first, len(c)))
        rank = np.arange(len(c)) - np.repeat(first, sizes)
        if large:
            out[fill[c] + rank] = at
            fill[c[first]] += sizes
        else:
            out[fill[c] - 1 - rank] = at
            fill[c[first]] -= sizes

    for c in np.flatnonzero(counts):
        done = heads[c]
        while done < fill[c]:
            done, wave = fill[c], out[done : fill[c]]
            put(wave, True)
        put(by[lms_ends[c - 1] if c else 0 : lms_ends[c]], True)
    fill = ends.copy()
    # the last suffix is the least of all and induced by none
    out[0] = n - 1
    for c in np.flatnonzero(counts)[::-1]:
        done = ends[c]
        while done > fill[c]:
            done, wave = fill[c], out[fill[c] : done][::-1]
            put(wave, False)
        put(out[heads[c] : heads[c] + n_large[c]][::-1], False)
    return out


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings, by place, and how many differ; `ordered` are their sorted places."""
    rank_of = np.empty(len(s), np.int64)
    rank_of[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms), 1) + 1
    length[-1] = 1
    a, b = ordered[:-1], ordered[1:]
    la, lb = length[rank_of[a]], length[rank_of[b]]
    same = la == lb
    open_, d = np.flatnonzero(same), 0
    while len(open_):
        equal = s[a[open_] + d] == s[b[open_] + d]
        same[open_[~equal]] = False
        d += 1
        open_ = open_[equal & (d < la[open_])]
    names = np.append(0, np.cumsum(~same))
    out = np.empty(len(lms), np.int64)
    out[rank_of[ordered]] = names
    return out, int(names[-1]) + 1 if len(names) else 0


def _sort_reduced(names: np.ndarray) -> np.ndarray:
    """Sorted suffixes of the string of names; the last name is the least and unique.

    Rank pairs at doubling distance; only suffixes that still share a rank are sorted again.
    """
    n, step = len(names), 1
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_names = names[order]
    starts = np.flatnonzero(np.append(True, sorted_names[1:] != sorted_names[:-1]))
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    sizes = np.diff(np.append(starts, n))
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order, in groups
    while len(open_):
        at = order[open_]
        group = rank[at]
        key = group * (n + 1) + rank[at + step]
        by = np.argsort(key, kind="stable")
        at, key, group = at[by], key[by], group[by]
        order[open_] = at
        new = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        rank[at] = np.repeat(open_[starts], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Sorted suffixes of numbers below `letters`; the last number is 0 and no other is."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rough = _induce(s, small, lms, letters)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    names, n_names = _names(s, lms, rough[is_lms[rough]])
    order = _sort_reduced(names) if n_names < len(lms) else np.argsort(names)
    return _induce(s, small, lms[order], letters)


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted: at each place, the prefix its suffix shares with the one sorted before it, `most` at most.

    A place whose left neighbour continues the same match has one less than that neighbour; only the
    other places are compared.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    fresh = np.ones(n, bool)
    ok = before[1:] > 0
    fresh[1:] = ~(ok & (s[:-1] == s[np.maximum(before[1:] - 1, 0)]))
    at = np.flatnonzero(fresh & (before >= 0))
    padded = np.append(s, np.arange(most + 1) * 0 - 1)
    got = np.zeros(n, np.int64)
    open_, d = at, 0
    while len(open_) and d < n:
        equal = (padded[open_ + d] == padded[before[open_] + d]) & (np.maximum(open_, before[open_]) + d < n)
        got[open_[~equal]] = d
        open_ = open_[equal]
        d += 1
    got[open_] = d
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    full = got[last] - (np.arange(n) - last)
    return np.minimum(np.maximum(full, 0), most)


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per part, which of its windows of `length` also start at another place of the parts."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    s = np.empty(int(ends[-1]) + 1, np.int64)
    s[:-1] = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    s[:-1] += 2
    s[ends - 1] = 1
    s[-1] = 0
    order = suffix_array(s, 258)
    shared = common_prefixes(s, order, length)
    inside = np.zeros(len(s), bool)
    for size, end in zip(sizes, ends, strict=True):
        inside[end - 1 - size : max(end - 1 - size, end - length)] = True
    place = order[1:]
    pair = (shared[place] >= length) & inside[place] & inside[order[:-1]]
    hit = np.zeros(len(s), bool)
    hit[place[pair]] = True
    hit[order[:-1][pair]] = True
    return [hit[end - 1 - size : max(end - 1 - size, end - length)] for size, end in zip(sizes, ends, strict=True)]


# --- segments ------------------------------------------------------------------------------------


@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all strings of GRAM bytes, by doubling."""
    h, width = _letters()[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        width *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def segments(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, anchor hash) of texts that lie end to end; places count from each text's start."""
    half = length // 2
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    row, lo, hi, begin, salt = _halves(gram_hashes(data), np.repeat(np.arange(len(at) - 1), np.diff(at)), length, GRAM, half)
    held = data.tobytes()
    keys = [xxhash.xxh3_64_intdigest(held[x : x + half], k) for x, k in zip(begin.tolist(), salt.tolist(), strict=True)]
    return row, lo - at[row], hi - at[row], np.array(keys, np.uint64)


def _halves(hashes: np.ndarray, row: np.ndarray, length: int, gram: int, half: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, start of the half, 1 or 2 for the half before or after the anchor), places overall."""
    span = length - gram + 1
    m = len(row) - length + 1
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    keyed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64) & mask
    blocks = -(-len(keyed) // span)
    grid = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(keyed)] = keyed
    grid = grid.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:m], ahead[span - 1 : span - 1 + m]) & mask).astype(np.int64)
    valid = row[:m] == row[length - 1 :]
    starts = valid.copy()
    starts[1:] &= (anchor[1:] != anchor[:-1]) | (row[1:m] != row[: m - 1]) | ~valid[:-1]
    stops = valid.copy()
    stops[:-1] &= starts[1:] | ~valid[1:]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    place = anchor[first]
    # windows that begin half a window or more before the anchor hold the half before it, others the one after it
    before, after = first <= place - half, last > place - half
    lo = np.concatenate([first[before], np.maximum(first, place - half + 1)[after]])
    hi = np.concatenate([np.minimum(last, place - half)[before], last[after]])
    begin = np.concatenate([place[before] - half, place[after]])
    return row[lo], lo, hi, begin, np.repeat([1, 2], [before.sum(), after.sum()])


class Words:
    """The words of texts that lie end to end, with 128-bit names of any of their runs."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        words, self.row = jaccard.word_hashes(data, at)
        n = len(words)
        power, inverse = jaccard._powers(max(20, n.bit_length()))
        self.inverse = inverse
        self.first = np.searchsorted(self.row, np.arange(len(at) - 1))
        self.sums = np.zeros((2, n + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k, x in enumerate((words, jaccard._mixed(words ^ np.uint64(0x5851F42D4C957F2D)))):
                np.cumsum(x * power[:n], out=self.sums[k, 1:])

    def names(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return tuple(jaccard._mixed((s[stop] - s[start]) * self.inverse[start]) for s in self.sums)


def word_segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor hash, name, name) for windows of WORDS words; places count words from each text's start."""
    words = Words(data, at)
    n = len(words.row)
    if n < WORDS:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64), none, none
    grams = np.arange(n - WORD_GRAM + 1)
    row, lo, hi, begin, salt = _halves(words.names(grams, grams + WORD_GRAM)[0], words.row, WORDS, WORD_GRAM, HALF_WORDS)
    keys = words.names(begin, begin + HALF_WORDS)[0] ^ (salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    s1, s2 = words.names(lo, hi + WORDS)
    return row, lo - words.first[row], hi - words.first[row], keys, s1.view(np.int64), s2.view(np.int64)


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Very long texts in blocks whose windows are all of theirs: (start within the text, bytes, offsets)."""
    block = 1 << 22
    if len(at) > 2 or len(data) <= block:
        yield 0, data, at
        return
    for start in range(0, max(1, len(data) - LENGTH + 1), block):
        part = data[start : start + block + LENGTH - 1]
        yield start, part, np.array([0, len(part)])


def _segment_rows(docs: DataFrame, whole: bool) -> DataFrame:
    """Anchor hashes of all segments, of bytes and of words; or whole rows: places, anchor hash and 128-bit content name."""
    schema = "doc_id long, h long, lo long, hi long, anchor long, s1 long, s2 long, words boolean" if whole else "doc_id long, anchor long, words boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (pa.array(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1))

            def rows(own: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, s1: np.ndarray, s2: np.ndarray, words: bool) -> pa.RecordBatch:
                own, kind = pa.array(own), pa.array(np.full(len(own), words))
                columns = [ids.take(own), texts.take(own), pa.array(lo), pa.array(hi), pa.array(anchor.view(np.int64)), pa.array(s1), pa.array(s2), kind] if whole else [ids.take(own), pa.array(anchor.view(np.int64)), kind]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, names=names)

            for a, b, data, at in byte_chunks(batch.column(2), CHUNK):
                row, lo, hi, anchor, s1, s2 = word_segments(data, at)
                if len(row):
                    yield rows(row + a, lo, hi, anchor, s1, s2, True)
                for start, part, bounds in _pieces(data, at):
                    row, lo, hi, anchor = segments(part, bounds)
                    if not len(row):
                        continue
                    name = np.zeros((len(row), 2), np.int64)
                    if whole:
                        held, first = part.tobytes(), bounds[row]
                        name = np.frombuffer(b"".join([xxhash.xxh3_128_digest(held[x:y]) for x, y in zip((first + lo).tolist(), (first + hi + LENGTH).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                    yield rows(row + a, lo + start, hi + start, anchor, name[:, 0], name[:, 1], False)

    return docs.mapInArrow(of, schema)


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of segments (doc_id, h, lo, hi, anchor, n, hot), and the windows' names of those of words."""
    lists = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi", "anchor", "n", "hot", "words", "known")).alias("parts"))
    schema = "doc_id long, h long, lo long, anchor long, n long, hot boolean, known boolean, content binary, windows array<struct<w1:long,w2:long>>"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.binary(), pa.list_(pa.struct([("w1", pa.int64()), ("w2", pa.int64())]))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            for doc, h, text, parts in zip(*[batch.column(k) for k in range(4)], strict=True):
                raw = (text.as_py() or "").encode()
                parts, own = parts.as_py(), (doc.as_py(), h.as_py())
                if any(p["words"] for p in parts):
                    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                for p in parts:
                    if p["words"]:
                        at = np.arange(p["lo"], p["hi"] + 1)
                        w1, w2 = words.names(at, at + WORDS)
                        rows.append((*own, p["lo"], p["anchor"], 1, False, p["known"], None, [{"w1": x, "w2": y} for x, y in zip(w1.view(np.int64).tolist(), w2.view(np.int64).tolist(), strict=True)]))
                    else:
                        rows.append((*own, p["lo"], p["anchor"], p["n"], p["hot"], False, raw[p["lo"] : p["hi"] + LENGTH], None))
                if len(rows) > 1000:
                    yield done(rows)
                    rows = []
            if rows:
                yield done(rows)

    return docs.join(lists, ["doc_id", "h"]).select("doc_id", "h", "text", "parts").mapInArrow(of, schema)


SPANS = "doc_id long, h long, start long, stop long"


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)


def _sharded(contents: DataFrame, n_bytes: int) -> DataFrame:
    shards = max(1, -(-n_bytes // SHARD_BYTES))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for flags, doc, h, lo, n in zip(repeated_starts(list(part["content"])), part["doc_id"], part["h"], part["lo"], part["n"], strict=True):
            if n == 1:
                rows += [(doc, h, lo + a, lo + b - 1 + LENGTH) for a, b in _runs(flags)]
        return pd.DataFrame(rows, columns=["doc_id", "h", "start", "stop"])

    dealt = contents.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda part: one(part), SPANS)


def _counted(contents: DataFrame) -> DataFrame:
    """The same for hot anchors: windows are grouped by their 128-bit hashes."""
    schema = "doc_id long, h long, n long, at long, w1 long, w2 long"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = row["content"]
                k = len(raw) - LENGTH + 1
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + LENGTH]) for i in range(k)), np.int64).reshape(-1, 2)
                same = [pa.array(np.full(k, row[c], np.int64)) for c in ("doc_id", "h", "n")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(row["lo"] + np.arange(k)), pa.array(names[:, 0]), pa.array(names[:, 1])], names=[x.split()[0] for x in schema.split(", ")])

    windows = cut(contents.mapInArrow(of, schema))
    twice = cut(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("w1", "w2"))
    hit = windows.filter("n = 1").join(twice, ["w1", "w2"], "left_semi")
    return hit.select("doc_id", "h", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("stop"))


def repeated_spans(texts: DataFrame, hot_contents: int = HOT_CONTENTS) -> DataFrame:
    """Of (doc_id, h, text): spans of repeated bytes (doc_id, h, start, stop), overlapping ones included, and rows with
    `passages` instead of a span, numbers of windows of WORDS words that stand in another document too."""
    spark = texts.sparkSession
    narrow = texts.select("doc_id", "h", "text")
    both = F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")
    several_docs = F.col("_a") < F.col("_b")
    anchors = _segment_rows(narrow, False).groupBy("words", "anchor").agg(F.count(F.lit(1)).alias("_k"), *both)
    anchors = cut(anchors.filter(F.when(F.col("words"), several_docs).otherwise(F.col("_k") > 1)).select("words", "anchor"))
    rows = cut(_segment_rows(narrow, True).join(anchors, ["words", "anchor"], "left_semi"))
    drop(anchors)
    release(spark)
    ids = ["words", "anchor", "s1", "s2"]
    contents = cut(rows.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), *both, *[F.first(c).alias(c) for c in ("doc_id", "h", "lo", "hi")]))
    again = F.when(F.col("words"), several_docs).otherwise(F.col("n") > 1)
    repeated = rows.join(contents.filter(again).select(*ids), ids, "left_semi")
    place, none = [F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("stop")], F.lit(None).cast("long")
    whole = repeated.filter("not words").select("doc_id", "h", *place, none.alias("passages"))
    own = ["doc_id", "h", "lo"]  # repeated rows are one document, whose segments of words count once
    known = repeated.filter("words").groupBy(*own).agg(F.any_value("hi").alias("hi")).groupBy("doc_id", "h").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("passages"))
    several = cut(contents.groupBy("words", "anchor").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("words", "anchor", (~F.col("words") & (F.col("_k") > hot_contents)).alias("hot")))
    # one segment of words that is repeated as a whole speaks for it to the others; those of one document stand for themselves
    fields = ["words", "anchor", "doc_id", "h", "lo", "hi", "n"]
    alone = rows.filter("words").join(contents.filter(F.col("words") & ~again).select(*ids), ids, "left_semi").dropDuplicates(own)
    edges = contents.filter(~F.col("words") | again).select(*fields, (F.col("words")).alias("known"))
    edges = edges.unionByName(alone.withColumn("n", F.lit(1).cast("long")).select(*fields, F.lit(False).alias("known"))).join(several, ["words", "anchor"])
    bytes_ = cut(_contents(narrow, edges))
    release(spark)
    in_words = bytes_.filter("windows is not null").select("doc_id", "h", "known", F.explode("windows").alias("w")).select("doc_id", "h", "known", "w.*")
    twice = in_words.groupBy("w1", "w2").agg(*both).filter(several_docs).select("w1", "w2")
    more = in_words.filter("not known").join(twice, ["w1", "w2"], "left_semi").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("passages"))
    passages = known.unionByName(more).select("doc_id", "h", none.alias("start"), none.alias("stop"), "passages")
    in_bytes = bytes_.filter("windows is null").drop("windows", "known")
    size = in_bytes.filter("not hot").agg(F.sum(F.length("content"))).first()[0] or 0
    spans = _sharded(in_bytes.filter("not hot"), size)
    if not in_bytes.filter("hot").isEmpty():
        spans = spans.unionByName(_counted(in_bytes.filter("hot")))
    return whole.unionByName(spans.withColumn("passages", none)).unionByName(passages)


DEDUPED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_windows long, kept binary"


def deduplicate(docs: DataFrame, hot_contents: int = HOT_CONTENTS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, n_passage_windows and kept (the bytes that stay).

    n_passage_windows: runs of WORDS words, whatever their bytes, that stand in a text of another id
    as well; ASCII letters without case.

    Null and empty texts have no bytes and lose none. Repeated rows are repeated text: whatever of
    them is long enough goes from each. Rows without an id are rows like others.
    """
    held = F.coalesce(F.col("text"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    texts = docs.select(own.alias("doc_id"), F.xxhash64(held).alias("h"), held.alias("text"))
    spans = cut(repeated_spans(texts, hot_contents))
    places = F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "stop"))).alias("spans")
    lists = cut(spans.groupBy("doc_id", "h").agg(places, F.sum("passages").alias("passages")))
    drop(spans)
    release(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, given, passages in zip(*[batch.column(k) for k in range(4)], strict=True):
                raw = text.as_py().encode()
                removed = n = at = 0
                kept = []
                places = given.values if given.is_valid else None
                pairs = sorted(zip(places.field("start").to_pylist(), places.field("stop").to_pylist(), strict=True)) if places is not None else []
                for start, stop in pairs:
                    if start > at or (start == 0 and n == 0):
                        kept.append(raw[at:start])
                        n += 1
                        removed += stop - start
                        at = stop
                    elif stop > at:
                        removed += stop - at
                        at = stop
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((None if doc.as_py() == -(1 << 63) else doc.as_py(), len(raw), removed, n, hashlib.sha256(rest).hexdigest(), passages.as_py() or 0, rest))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in DEDUPED.split(", ")])

    return texts.join(lists, ["doc_id", "h"], "left").select("doc_id", "text", "spans", "passages").mapInArrow(of, DEDUPED)
