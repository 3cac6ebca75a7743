"""Vector best-fit packing of token sequences.

Every piece asks for three things of a bin: tokens, one of its documents, and attention cost (the
square of its length). Pieces go in falling length to the open bin that can hold them in all three
and whose weighted residual is best; a new bin is opened only if none can.

Spark deals the pieces into groups of about `group_rows` at random, so that a group's lengths are
those of the corpus, and packs each group by itself: a group has a fixed size whatever the corpus
has, and loses at most its last bin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import cut
from quernel.llm.tokens import encoder

CAPACITY = 2048
#: Limits that bind only on degenerate input: as many documents as tokens, and the cost of one full document.
MOST_DOCUMENTS = CAPACITY
MOST_COST = CAPACITY**2
WEIGHTS = (1.0, 1e-3, 1e-3)
GROUP_ROWS = 4096
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document's ids and the end id; null text counts as empty.

    A document of more than `capacity` ids is cut from its end, so only its first piece is shorter.
    Repeated rows give repeated pieces.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, PIECES)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY, most_documents: int = MOST_DOCUMENTS, most_cost: float = MOST_COST, weights: tuple = WEIGHTS, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.

    score "norm": the bin with the least weighted norm of what stays free; "dot": the bin with the
    greatest weighted dot product of the demand and the residual. Both see only bins that hold the
    piece under every limit. Ties go to the bin opened first.
    """
    n = len(lengths)
    where, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 0:
        return where, offsets
    limits = np.array([capacity, most_documents, most_cost], float)
    free, ids, opened, live = np.empty((3, n)), np.empty(n, np.int64), 0, 0
    w = np.asarray(weights, float)[:, None]
    least = float(lengths.min())
    for i in np.argsort(-lengths, kind="stable"):
        ask = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if (ask > limits).any():
            raise ValueError(f"a piece of {lengths[i]} tokens fits no bin")
        left = free[:, :live] - ask[:, None]
        fits = (left >= 0).all(axis=0)
        if fits.any():
            scaled = left / limits[:, None] if score == "norm" else -(free[:, :live] / limits[:, None]) * (ask / limits)[:, None]
            value = (w * scaled**2).sum(axis=0) if score == "norm" else (w * scaled).sum(axis=0)
            k = int(np.argmin(np.where(fits, value, np.inf)))
        else:
            free[:, live], ids[live], k = limits, opened, live
            opened, live = opened + 1, live + 1
        where[i], offsets[i] = ids[k], capacity - free[0, k]
        free[:, k] -= ask
        if free[0, k] < least or free[1, k] < 1:  # nothing that is left can enter it
            live -= 1
            free[:, k : live], ids[k:live] = free[:, k + 1 : live + 1], ids[k + 1 : live + 1]
    return where, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, most_documents: int = MOST_DOCUMENTS, most_cost: float = MOST_COST, weights: tuple = WEIGHTS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows that have a `length`; an empty table gives an empty one."""
    parts = cut(parts)
    groups = max(1, -(-parts.count() // group_rows))
    # by place, not by content: repeated rows spread like others; the places are those of written files
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        where, offsets = best_fit(rows["length"].to_numpy(np.int64), capacity, most_documents, most_cost, weights)
        return rows.drop(columns="_group").assign(sequence_id=(int(key[0]) << 24) + where, offset=offsets)

    return dealt.groupBy("_group").applyInPandas(one, schema)
