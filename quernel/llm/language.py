"""Language identification by fusing evidence.

Three kinds of evidence meet in one posterior per document: the likelihood of its whole text under
byte-trigram models, its declared language given each language (rates estimated by grouped counts),
and a prior of its host. Host priors are smoothed in steps, host to address suffix to all
documents, over counts of what the texts alone say; counts are grouped sums, so a hot host costs no
more than any other.

The models are fitted on a bounded sample of labelled rows, `SAMPLE` of each of the `MOST_LANGUAGES`
labels that most rows have; all else covers all rows. So what is broadcast is bounded as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import byte_chunks, cut

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Labelled rows of a language that its model is fitted on, and languages that have a model, at most.
SAMPLE = 1000
MOST_LANGUAGES = 256
#: Trigrams of a text that count in full; more add nothing, as they are not independent.
MOST_GRAMS = 200
#: How far below an even spread over the trigrams seen the unknown language is: text must be that alien.
MARGIN = 1.5
HOST_WEIGHT = 20.0
SUFFIX_WEIGHT = 100.0
DECLARED_WEIGHT = 50.0
DECLARED_RIGHT = 0.9
ACCEPT = 0.5
#: Letters without case; all other ASCII is a space. Bytes of other scripts stand for themselves.
_LETTER = np.arange(256, dtype=np.uint32)
_LETTER[65:91] += 32
_LETTER[[k for k in range(128) if not chr(k).isalpha()]] = 32


@dataclass(frozen=True)
class Models:
    languages: tuple[str, ...]
    log_p: np.ndarray  # languages x buckets; the last is the unknown language


def grams(data: np.ndarray) -> np.ndarray:
    """A bucket for each byte and the two after it; 0 for those with a space on both sides or two spaces side by side.

    So numbers, signs and addresses' dots say nothing of a language.
    """
    x = _LETTER[data]
    blank = x == 32
    idle = (blank[1:-1] & (blank[:-2] | blank[2:])) | (blank[:-2] & blank[2:])
    which = ((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(7)) % np.uint32(BUCKETS - 1) + np.uint32(1)
    which[idle] = 0
    return which


def fit(docs: DataFrame, sample: int = SAMPLE) -> Models:
    """Models of the languages that label the sample; rows without a label or text are not used.

    Labels are counted over all rows. Of each, the sample is the `sample` rows whose hashes of id and
    text are least, repeated rows once: the same rows at each run, and no more if an id is repeated. With no labelled
    rows there is only the unknown language.
    """
    top = (1 << 63) - 1
    labelled = docs.filter(F.col("lang").isNotNull() & (F.char_length("text") > 2)).select("doc_id", "text", "lang")
    labelled = labelled.withColumn("_h", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(top)))
    totals = F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("_h").alias("n")
    counts = labelled.groupBy("lang").agg(*totals).orderBy(F.desc("rows"), "lang").limit(MOST_LANGUAGES).collect()
    # by the hash alone about twice the rows that are kept, so that no label's rows are all sorted
    least = F.lit(None).cast("long")
    if counts:
        least = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(top, 2 * sample * top // max(1, r["n"])))]), F.col("lang"))
    few = labelled.filter(F.col("_h") <= least).dropDuplicates(["lang", "_h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "text"))
    kind = "lang string, counts array<int>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, data, at in byte_chunks(batch.column(0)):
                for i in range(a, b):
                    got = np.bincount(grams(data[at[i - a] : at[i - a + 1]]), minlength=BUCKETS)
                    got[0] = 0
                    sums[langs[i]] = sums.get(langs[i], 0) + got
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.string()), pa.array([x.astype(np.int32) for x in sums.values()], pa.list_(pa.int32()))], names=["lang", "counts"])

    # bounded rows in a few tasks: what reaches the driver is one array for each language and task
    chosen = few.withColumn("_place", place).filter(F.col("_place") <= sample).select("text", "lang").coalesce(8)
    totals: dict[str, np.ndarray] = {}
    for row in chosen.mapInArrow(count, kind).toLocalIterator():
        totals[row["lang"]] = totals.get(row["lang"], 0) + np.array(row["counts"], np.int64)
    names = sorted(totals)
    seen = sum((totals[n] > 0 for n in names), np.zeros(BUCKETS, np.int64)) > 0
    flat = np.full(BUCKETS, -np.log(max(2, int(seen.sum()))) - MARGIN)
    log_p = [np.log((totals[n] + 0.05) / (totals[n].sum() + 0.05 * BUCKETS)) for n in names]
    out = np.array([*log_p, flat], np.float32)
    out[:, 0] = 0
    return Models((*names, UNKNOWN), out)


def likelihoods(docs: DataFrame, models: Models) -> DataFrame:
    """(id columns..., n_grams, log_l): mean log-likelihoods of each whole text, times its effective length."""
    held = docs.sparkSession.sparkContext.broadcast(models)
    keep = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_grams long, log_l array<double>"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = held.value.log_p
        for batch in batches:
            sizes, means = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(log_p)))
            for a, b, data, at in byte_chunks(batch.column(batch.schema.get_field_index("text"))):
                n = np.maximum(np.diff(at) - 2, 0)
                some = n > 0
                if not some.any():
                    continue
                which = grams(data)
                counts = np.append(0, np.cumsum(which > 0))
                # from each text's first gram to its last; those across the border of two texts are left out
                edges = np.column_stack([at[:-1][some], at[:-1][some] + n[some]]).ravel()
                edges = np.minimum(edges, len(which))
                last = edges[-1] == len(which)
                for k in range(len(log_p)):
                    sums = np.add.reduceat(log_p[k][which].astype(np.float64), edges[:-1] if last else edges)[::2]
                    means[a:b, k][some] = sums
                first = np.minimum(at[:-1], len(which))
                n = counts[first + np.minimum(n, len(which) - first)] - counts[first]
                means[a:b] /= np.maximum(n, 1)[:, None]
                sizes[a:b] = n
            values = means * np.minimum(sizes, MOST_GRAMS)[:, None]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(sizes), pa.array(list(values), pa.list_(pa.float64()))], names=[*keep, "n_grams", "log_l"])

    return docs.mapInArrow(of, schema)


def _shares(counts: list[Column], parent: list[Column], weight: float) -> list[Column]:
    total = reduce(lambda a, b: a + b, counts)
    return [(c + weight * p) / (total + weight) for c, p in zip(counts, parent, strict=True)]


def identify(docs: DataFrame, models: Models | None = None, host: str = "source", suffix: Column | None = None, declared: str = "lang", accept: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: its columns but the text, and language, probability, declared, text_language, kept.

    suffix: the step above the host, as an address's last label; without one it is the same for all.
    kept: the language is a known one and its posterior is at least `accept`. Texts without
    three letters in a row and null texts have no likelihood; they are unknown and not kept, whatever is declared.
    Null hosts are one host; a null declaration is no evidence. Columns of docs named like the
    outputs give way to these.
    """
    models = models or fit(docs, sample)
    names = models.languages
    n = len(names)
    rows = docs.select("doc_id", "text", F.col(host).alias("_host"), (F.lit("") if suffix is None else suffix).alias("_suffix"), F.col(declared).alias("_declared"))
    scored = likelihoods(rows, models)
    top = F.array_position(F.col("log_l"), F.array_max("log_l")).cast("int") - 1
    scored = cut(scored.withColumn("_top", F.when(F.col("n_grams") > 0, top).otherwise(n - 1)))
    # grouped sums: counts of what the texts say by host, and of declarations by what the texts say
    count = [F.count_if(F.col("_top") == k).cast("double").alias(f"c{k}") for k in range(n)]
    hosts = cut(scored.groupBy("_host", "_suffix").agg(*count))
    suffixes = hosts.groupBy("_suffix").agg(*[F.sum(f"c{k}").alias(f"s{k}") for k in range(n)])
    whole = hosts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(n)]).first()
    total = sum(whole) + n
    common = [F.lit((whole[k] + 1) / total) for k in range(n)]
    by_suffix = suffixes.select(F.col("_suffix").alias("_s"), F.array(*_shares([F.col(f"s{k}") for k in range(n)], common, SUFFIX_WEIGHT)).alias("_up"))
    joined = hosts.join(by_suffix, hosts["_suffix"].eqNullSafe(by_suffix["_s"]))
    prior = joined.select(F.col("_host").alias("_h"), F.col("_suffix").alias("_s"), F.array(*_shares([F.col(f"c{k}") for k in range(n)], [F.get("_up", F.lit(k)) for k in range(n)], HOST_WEIGHT)).alias("_prior"))
    said = {(r["_top"], r["_declared"]): r["count"] for r in scored.filter(F.col("_declared").isin(*names)).groupBy("_top", "_declared").count().collect()}
    rates = []
    for d in names:
        row = []
        for k, name in enumerate(names):
            first = DECLARED_RIGHT if d == name else (1 - DECLARED_RIGHT) / max(1, n - 1)
            row.append((said.get((k, d), 0) + DECLARED_WEIGHT * first) / (sum(said.get((k, e), 0) for e in names) + DECLARED_WEIGHT))
        rates.append(row)
    even = F.array(*[F.lit(1.0)] * n)
    given = F.coalesce(F.element_at(F.create_map(*[x for d, row in zip(names, rates, strict=True) for x in (F.lit(d), F.array(*[F.lit(float(v)) for v in row]))]), F.col("_declared")), even)
    fused = scored.join(prior, scored["_host"].eqNullSafe(prior["_h"]) & scored["_suffix"].eqNullSafe(prior["_s"]))
    logs = F.transform(F.arrays_zip(F.col("log_l").alias("l"), F.col("_prior").alias("p"), given.alias("g")), lambda x: x["l"] + F.log(x["p"]) + F.log(x["g"]))
    fused = fused.withColumn("_logs", logs)
    best = F.array_max("_logs")
    mass = F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_logs")))
    which = F.array_position(F.col("_logs"), best).cast("int") - 1
    has = F.col("n_grams") > 0
    labels = F.array(*[F.lit(x) for x in names])
    out = fused.select(
        "doc_id",
        F.when(has, F.get(labels, which)).otherwise(UNKNOWN).alias("language"),
        F.when(has, F.round(1 / mass, 6)).otherwise(0.0).alias("probability"),
        F.col("_declared").alias("declared"),
        F.get(labels, F.col("_top")).alias("text_language"),
        F.col("n_grams"),
    )
    return out.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("probability") >= accept))


def page_fields(pages: DataFrame) -> DataFrame:
    """Pages as documents: id, text without tags, declared markup language, host and the address's last label."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " "), r"<[^<>]*>", " ")
    lang = F.lower(F.regexp_extract(html, r"""(?i)<html[^<>]*\slang=["']?([A-Za-z]+)""", 1))
    return pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), F.nullif(lang, F.lit("")).alias("lang"), host.alias("source"), F.regexp_extract(host, r"([^.]*)$", 1).alias("suffix"))
