"""The registered queries themselves: their columns and types, and digests against brute force."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernel.llm.queries import QUERIES
from tests.llm.test_operators import WORD, _base_spans, docs, rows  # noqa: F401

KINDS = ("email", "ip", "card", "phone")
COLUMNS = {
    "op2_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op8_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_media_gif": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op10_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):  # noqa: F811
    at = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(at / "documents.parquet"))
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(at / "labels.parquet"))
    return str(at)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, folder, name):
    got = dict(QUERIES[name](spark, folder).dtypes)
    assert {k: got.get(k) for k in COLUMNS[name]} == COLUMNS[name]


def test_personal_data(spark, folder, rows):  # noqa: F811
    got = QUERIES["op5_personal_data"](spark, folder).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        spans = _base_spans(texts[r.doc_id])
        listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_personal_data_counts_each_kind(spark, tmp_path):
    texts = ["a@b.c card 4111 1111 1111 1111, 4111111111111111; ip 1.2.3.4 tel +1 (555) 123-4567", "10.0.0.1, 10.0.0.2 and 10.0.0.3", "x", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: [r[f"n_{k}"] for k in KINDS] for r in QUERIES["op5_personal_data"](spark, str(tmp_path)).collect()}
    assert got == {0: [1, 1, 2, 1], 1: [0, 3, 0, 0], 2: [0] * 4, 3: [0] * 4}


def test_mixture_sizes_and_limits(spark, folder, rows):  # noqa: F811
    got = QUERIES["op2_source_mix"](spark, folder).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(r.size == len(WORD.findall(texts[r.doc_id])) and 0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    by = {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        by[source[r.doc_id]] = (r.target, r.source_size)
    assert abs(sum(t for t, _ in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * n + 1e-6 for t, n in by.values())
    assert Counter(map(tuple, got)) == Counter(map(tuple, QUERIES["op2_source_mix"](spark, folder).collect()))


def test_media_digests(spark, folder, rows):  # noqa: F811
    texts = {r[0]: r[1] or "" for r in rows}
    for r in QUERIES["op9_media_gif"](spark, folder).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_packing_is_gapless(spark, folder, rows):  # noqa: F811
    import numpy as np

    from quernel.llm import tokens

    texts = {r[0]: r[1] or "" for r in rows}
    bins: dict[int, list] = {}
    for r in QUERIES["op8_best_fit_packing"](spark, folder).collect():
        ids = np.append(tokens.encoder()(texts[r.doc_id]), 0).astype("<u4")[r.start : r.start + r.length]
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(ids.tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
