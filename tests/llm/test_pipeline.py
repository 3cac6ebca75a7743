"""Each stage of the pipeline against a brute-force version, on rows without ids, repeated rows and copies."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from quernel.llm import mixing, pii, tokens
from tests.llm.test_operators import WORD, _base_spans, _sentence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_ string"


@pytest.fixture(scope="module")
def rows():
    base = _sentence(21, 120)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (30, 90)]
    texts = [base, base.upper(), *near, *[_sentence(30 + k, 60 + k) for k in range(12)], f"mail a.b@c.de {_sentence(50, 40)} ip 10.1.2.3"]
    out = [(5 + i, t, "en", f"s{i % 3}", len(t), "clash") for i, t in enumerate(texts)]
    out += [out[0], out[4], (None, base, "en", "s0", 1, "c"), (None, _sentence(70, 50), None, None, None, "c"), (90, None, "en", "s1", 0, "c"), (91, "", "en", None, 0, "c")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _columns(df):
    assert tuple(df.columns) == pipeline.COLUMNS
    return [tuple(r) for r in df.collect()]


def test_near_duplicates(spark, docs, rows):
    got = _columns(pipeline.near_duplicate_stage(spark, docs, ""))
    units = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows}, key=lambda x: (x[0], x[1], x[2] or ""))
    sets = []
    for _, _, text in units:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(units)))
    for i in range(len(units)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    kept = Counter((None if units[g][0] else units[g][1], units[g][2]) for g in set(group))
    assert Counter((r[0], r[1]) for r in got) == kept


def test_personal_data_is_marked(spark, docs, rows):
    got = _columns(pipeline.personal_data_stage(spark, docs, ""))
    wanted = Counter()
    for i, text, lang, source, *_ in rows:
        out, at = "", 0
        for a, k, b in _base_spans(text or ""):
            if a >= at:
                out += (text or "")[at:a] + f"<{pii.KINDS[k].upper()}>"
            at = max(at, b)
        clean = None if text is None else out + text[at:]
        wanted[i, clean, lang, source, None if clean is None else len(clean)] += 1
    assert Counter(got) == wanted


def test_mixture_takes_what_the_operator_says(spark, docs, rows):
    got = Counter(_columns(pipeline.mixture_stage(spark, docs, "")))
    keyed = docs.select(*pipeline.COLUMNS).withColumn("_key", pipeline._key(pipeline.COLUMNS))
    copies = Counter()
    for r in mixing.mix(keyed.selectExpr("_key as doc_id", "text", "source")).collect():
        copies[r.doc_id] += r.copies
    wanted = Counter({tuple(r[:5]): copies[r["_key"]] for r in keyed.collect()})
    assert got == +wanted
    have = Counter(tuple(r[:5]) for r in rows)
    assert all(n <= 2 * have[r] for r, n in got.items())


def test_packing_holds_every_token(spark, docs, rows):
    got = pipeline.packing_stage(spark, docs.select(*pipeline.COLUMNS), "").collect()
    assert sum(r.length for r in got) == sum(len(tokens.encoder()(r[1] or "")) + 1 for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_language_rejects_only_what_has_none(spark, docs, rows):
    got = _columns(pipeline.language_stage(spark, docs, ""))
    assert Counter((r[0], r[1]) for r in got) <= Counter((r[0], r[1]) for r in rows)
    assert not any(r[1] in (None, "") for r in got) and all(r[2] for r in got)


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
