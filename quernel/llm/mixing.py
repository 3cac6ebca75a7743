"""Mixing sources to target weights by cube-method balanced sampling.

Targets: weights share `share` times all sizes among the sources; a target stops at `most` times its
source's size, and what it leaves is shared again by weight. A source whose target is r times its
size takes every document floor(r) times and one time more with inclusion probability r - floor(r).

Those probabilities are settled by the cube method. Within a source, the vector of probabilities is
moved through the null space of two constraints, the number of documents and the number of words,
until a coordinate becomes 0 or 1. Spark deals a source's documents into chunks of about `chunk_rows`
(a hot source has many). A chunk keeps `KEPT` documents, spread over its range of sizes, out of the
walk, and the walk leaves two at most; those are chunked again, and so on until a source has one
chunk. What that one leaves is the landing problem, settled by trying all its outcomes.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
CHUNK_ROWS = 4096
CLOSE = 1e-9
KEPT = 10


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size); null is a source of its own, last in order.

    One row per source. Order numbers come from a range sort and the row counts of its partitions;
    the driver gets those counts and a few sums, never the sources.
    """
    by = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    placed = cut(by.sort(F.asc_nulls_last("source")).withColumn("_at", F.monotonically_increasing_id()))
    before, counts = 0, []
    for part, n in sorted(map(tuple, placed.groupBy(F.shiftright("_at", 33)).count().collect())):
        counts.append((part, before))
        before += n
    first = F.create_map(*[F.lit(x) for pair in counts for x in pair])[F.shiftright("_at", 33)] if counts else F.lit(0)
    place = F.pmod(first + F.col("_at").bitwiseAND((1 << 33) - 1), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    placed = placed.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    total, rate = placed.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while total:  # the excess of full sources goes to the others until no target is above its cap
        full = F.col("_weight") * rate >= F.col("_cap")
        spent, weighs = placed.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        new = (share * total - (spent or 0)) / weighs if weighs else rate
        if new <= rate * (1 + 1e-15):
            break
        rate = new
    return placed.select("source", "source_size", "n_docs", F.least(F.col("_weight") * rate, "_cap").alias("target"))


def walk(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Flight phase: probabilities after the walk; two at most stay strictly between 0 and 1.

    The sums of p and of p * size stay as they were. Rows go in the order given.
    """
    p, active = list(p), []
    for i in range(len(p)):
        if not CLOSE < p[i] < 1 - CLOSE:
            p[i] = float(p[i] >= 0.5)
            continue
        active.append(i)
        if len(active) < 3:
            continue
        a, b, c = (size[k] for k in active)
        u = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(active, u, strict=True) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(active, u, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for k, x in zip(active, u, strict=True):
            p[k] += step * x
            if not CLOSE < p[k] < 1 - CLOSE:
                p[k] = float(p[k] >= 0.5)
        active = [k for k in active if 0 < p[k] < 1]
    return p


def land(p: list[float], size: list[float]) -> list[float]:
    """Settles the last rows: the outcome nearest in words, then in documents."""
    free = [i for i, x in enumerate(p) if 0 < x < 1]
    words, docs = sum(p[i] * size[i] for i in free), sum(p[i] for i in free)

    def off(bits: int) -> tuple:
        on = [i for k, i in enumerate(free) if bits >> k & 1]
        return round(abs(sum(size[i] for i in on) - words), 3), abs(len(on) - docs), bits

    best, p = min(range(1 << len(free)), key=off), list(p)
    for k, i in enumerate(free):
        p[i] = float(best >> k & 1)
    return p


def cube(units: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """units (source, doc_id, size, p, n_docs, ...) with p settled to 0 or 1, balanced within each source."""
    schema = units.schema
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def settle(last: bool):
        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.assign(_k=pd.util.hash_array(rows["doc_id"].fillna(-1).to_numpy("int64")).astype("int64"))
            rows = rows.sort_values(["size", "_k"], ascending=[False, True], kind="stable").drop(columns=["_k", "_chunk"])
            seed = f"{rows['source'].iloc[0]}|{rows['doc_id'].iloc[0]}|{len(rows)}"
            size = rows["size"].astype(float).tolist()
            p = rows["p"].tolist()
            spread = {len(p) * k // KEPT for k in range(KEPT)}
            moving = [i for i in range(len(p)) if i not in spread]
            for i, x in zip(moving, walk([p[i] for i in moving], [size[i] for i in moving], random.Random(seed)), strict=True):
                p[i] = x
            return rows.assign(p=land(p, size) if last else p)

        return one

    done, open_, level = [], units, 0
    while True:
        most = open_.agg(F.max("n_docs")).first()[0] or 0
        last = most <= chunk_rows
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / chunk_rows)).cast("long")
        dealt = open_.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", F.lit(level)), chunks))
        settled = cut(dealt.groupBy("source", "_chunk").applyInPandas(settle(last), names))
        if last:
            done.append(settled)
            break
        free = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(settled.filter(~free))
        rest = settled.filter(free).drop("n_docs")
        counts = rest.groupBy(F.col("source").alias("_by")).agg(F.count(F.lit(1)).alias("n_docs"))
        open_ = rest.join(counts, F.col("source").eqNullSafe(F.col("_by"))).select(schema.names)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    size: words of the whole text, 0 for null or empty text, whose taken is 0 as well. A source
    without words has target 0. Reruns agree: chunks and random steps follow from ids and sizes.
    Repeated rows are rows of their own; an empty table gives an empty table.
    """
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("size")))
    sources = cut(source_targets(sizes, weights, share, most).withColumnRenamed("source", "_by"))
    joined = sizes.join(sources, F.col("source").eqNullSafe(F.col("_by"))).drop("_by")
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    joined = joined.withColumn("_whole", F.floor(ratio + CLOSE).cast("int")).withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("_whole")))
    joined = cut(joined)
    asks = (F.col("size") > 0) & (F.col("p") > CLOSE)
    settled = cube(joined.filter(asks), chunk_rows)
    both = settled.unionByName(joined.filter(~asks).withColumn("p", F.lit(0.0)))
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.col("p").cast("int")).otherwise(0)
    return both.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
