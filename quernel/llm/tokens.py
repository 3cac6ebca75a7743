"""Token ids and edit-aware token counts.

A document is kept as pre-token segments, each a leaf of a tree whose inner nodes hold the
characters and the token counts below them. A leaf ends wherever a character that is not white
space is followed by white space: no pre-token of the byte-level pattern spans such a place and none
looks back across it, so leaves are encoded apart and their counts add up to the whole text's. An
edit finds its leaves by the tree, re-encodes these and no others, and updates the sums above. The
tree is two arrays of a row, so it is stored with its document and the next edits begin with it.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

@cache
def encoder(name: str = "byte_bpe_50k") -> Callable[[str], np.ndarray]:
    """Text to ids, those of the tokenizer file `name`.json, whose vocabulary `name`.tiktoken has as ranks.

    The ranks are faster to apply; what their engine refuses, such as huge runs of white space, the
    tokenizer file itself encodes. Strings of special tokens are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cache
    def plain():
        from tokenizers import Tokenizer

        it = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        it.encode_special_tokens = True
        return it

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # noqa: BLE001  the engine's panics are no Exception
            return np.array(plain().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


@cache
def byte_lengths(name: str = "byte_bpe_50k") -> np.ndarray:
    """The bytes of each id."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        sizes = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, lines)}
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


#: What Unicode calls white space, up to its last code point. A leaf may end before those of ASCII that every engine knows.
_SPACES = np.zeros(0x3002, bool)
_SPACES[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def ends(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where leaves end, in code points and in bytes; the text's end is one."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.append(np.flatnonzero(~_SPACES[np.minimum(points[:-1], 0x3001)] & np.isin(points[1:], (32, 9, 10, 13))) + 1, len(points))
    sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return at, np.cumsum(sizes)[at - 1]


def leaf_counts(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters, tokens) of each leaf of a text with these ids; one empty leaf for no text."""
    if not text:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    chars, places = ends(text)
    before = np.searchsorted(np.cumsum(lengths[ids]), places, "right")
    return np.diff(chars, prepend=0), np.diff(before, prepend=0)


class CountTree:
    """Characters and tokens of leaves under sums. Its shape is fixed: an edit refills the leaves it touches,
    leaving some empty or letting the last hold several segments."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.width = 1 << (len(chars) - 1).bit_length()
        self.chars, self.tokens = (self._sums(x) for x in (chars, tokens))
        self.n = len(chars)

    def _sums(self, leaves: np.ndarray) -> list[int]:
        level = np.zeros(self.width, np.int64)
        level[: len(leaves)] = leaves
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        return [0, *np.concatenate(levels[::-1]).tolist()]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array(x[self.width : self.width + self.n], np.int64) for x in (self.chars, self.tokens))

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its start) of the character at a place; the last leaf's for the text's end."""
        k, left = 1, min(place, self.chars[1] - 1)
        start = left
        while k < self.width:
            k *= 2
            if left >= self.chars[k]:
                left -= self.chars[k]
                k += 1
        return k - self.width, start - left

    def _put(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.width + leaf
        more, added = chars - self.chars[k], tokens - self.tokens[k]
        while k and (more or added):
            self.chars[k] += more
            self.tokens[k] += added
            k //= 2

    def replace(self, text: str, start: int, stop: int, new: str, encode: Callable[[str], np.ndarray], lengths: np.ndarray) -> tuple[str, int]:
        """Puts `new` for the characters [start, stop) of the tree's text, both clipped to it: (the text after, characters encoded)."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        after = text[:start] + new + text[stop:]
        if not size:
            a, b, low, high = 0, 0, 0, len(after)
        else:
            # the leaf before an edit at its edge is touched, as is the one after: the places there may be none any more
            (a, low), (b, last) = self.find(max(0, start - 1)), self.find(stop)
            high = last + self.chars[self.width + b] + len(new) - (stop - start)
        part = after[low:high]
        chars, tokens = leaf_counts(part, encode(part), lengths)
        room = b - a + 1
        if len(chars) > room:
            chars, tokens = (np.append(x[: room - 1], x[room - 1 :].sum()) for x in (chars, tokens))
        for k in range(room):
            self._put(a + k, int(chars[k]) if k < len(chars) else 0, int(tokens[k]) if k < len(tokens) else 0)
        return after, len(part)


def _arrays(columns: list, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = columns or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


_TREE = "doc_id long, text string, chars binary, tokens binary, encoded_chars long"
_EDITS = "edits array<struct<start:long,stop:long,text:string>>"
_KINDS = {"doc_id": pa.int64(), "text": pa.string(), "chars": pa.binary(), "tokens": pa.binary(), "encoded_chars": pa.int64()}


def trees(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, text, chars, tokens, encoded_chars, edits): each document with its leaves as little-endian 32-bit numbers, to be kept.

    Null text is empty and has one empty leaf. `edits` goes through if docs have it.
    """
    has = "edits" in docs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(tokenizer), byte_lengths(tokenizer)
        for batch in batches:
            out = []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                chars, counts = leaf_counts(text, encode(text), lengths)
                out.append((doc, text, chars.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), len(text)))
            plain = _arrays(list(zip(*out, strict=True)), _KINDS)
            yield pa.RecordBatch.from_arrays([*plain.columns, batch.column(2)], names=[*plain.schema.names, "edits"]) if has else plain

    wanted = [F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col("edits").cast(_EDITS.partition(" ")[2])] if has else [])]
    return docs.select(*wanted).mapInArrow(of, f"{_TREE}, {_EDITS}" if has else _TREE)


EDITED = "doc_id long, text string, chars binary, tokens binary, encoded_chars long, n_tokens long, n_tokens_edited long, n_leaves int, n_edits int, reencoded_chars long"


def apply_edits(kept: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Trees with `edits` after these, with the counts before and after; whole texts are not encoded again.

    Edits are (start, stop, text) in code points of the text as the edits before have left it. Null
    edits are none; a null replacement deletes.
    """
    kinds = _KINDS | {"n_tokens": pa.int64(), "n_tokens_edited": pa.int64(), "n_leaves": pa.int32(), "n_edits": pa.int32(), "reencoded_chars": pa.int64()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(tokenizer), byte_lengths(tokenizer)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tree = CountTree(*(np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("chars", "tokens")))
                before, text, again, edits = tree.total, row["text"] or "", 0, row["edits"] or []
                for e in edits:
                    text, n = tree.replace(text, e["start"], e["stop"], e["text"] or "", encode, lengths)
                    again += n
                chars, counts = tree.leaves()
                out.append((row["doc_id"], text, chars.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), row["encoded_chars"], before, tree.total, tree.n, len(edits), again))
            yield _arrays(list(zip(*out, strict=True)), kinds)

    return kept.select(*_KINDS, "edits").mapInArrow(of, EDITED)


def edit_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Counts before and after the edits of each row of (doc_id, text, edits), one row for each."""
    out = apply_edits(trees(docs, tokenizer), tokenizer)
    return out.select("doc_id", "n_tokens", "n_tokens_edited", "n_leaves", "n_edits", "encoded_chars", "reencoded_chars")


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits to each text: five characters at a quarter, a half and three quarters become a mark."""
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    at = [F.floor(n * k / 4).cast("long") for k in (3, 2, 1)]  # from the end, so that places stay true
    return docs.withColumn("edits", F.array(*[F.struct(a.alias("start"), (a + 5).alias("stop"), F.lit(" [edited]").alias("text")) for a in at]))
