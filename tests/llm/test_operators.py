"""Each operator against a brute-force version, on a fixture with all the awkward rows, and on an empty table."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import gif, jaccard, language, mixing, packing, pii, quality, suffixes, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, p double, h long, node long, spans string, base string, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(n))


def _texts() -> list[str | None]:
    base, shared = _sentence(1, 300), _sentence(2, 120)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (10, 150, 280)]
    chain = [" ".join(words[7 * k :] + _sentence(50 + k, 7 * k).split()) for k in range(1, 5)]
    return [
        None, "", " \t\n", "a", "One two three", "one TWO three", base, base, base.upper(), *near, *chain,
        _sentence(3, 80) + shared + _sentence(4, 80), _sentence(5, 60) + "\n" + shared, "x" * 3000, "ab " * 900, _sentence(6, 6000), "éè ü 漢字 \U0001f600 " * 60,
        "mail a.b@c.de+d@e.f x@y.z.. ip 1.2.3.4 999.1.1.1 1.2.3.4.5 card 4111 1111 1111 1111 4111-1111-1111-1112 tel +1 (555) 123-4567. +12 no",
        "same\nsame\nother\n\nsame\n" + "w " * 25, "<b> # $ % & | " * 9, "café " * 30,
    ]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    return [*out, out[6]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, None, 1, 0.5, 2, 3, "s", "b", 4) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _luhn(d: str) -> bool:
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _base_spans(text: str) -> list[tuple[int, int, int]]:
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(d) <= 19 and _luhn(d)) or k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_mixture(docs, empty, rows):
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    by = Counter()
    for r in rows:
        by[r[3]] += size[r[0]]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    left, open_, target = 1.5 * sum(by.values()), set(by), {}
    while True:
        rate = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if rate * weights[s] >= 2 * by[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * by[s]
            left -= target[s]
        open_ -= full
        if not open_:
            break
    target |= {s: rate * weights[s] for s in open_}
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by[r.source] and r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.1)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(empty).count() == 0


def test_mixture_in_chunks(spark):
    rng = np.random.default_rng(0)
    many = spark.createDataFrame([(i, "w " * int(rng.integers(1, 60)), "s" if i % 3 else None) for i in range(900)], "doc_id long, text string, source string")
    got = mixing.mix(many, weights=(1, 1), chunk_rows=64)
    for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k")).collect():
        assert abs(r.t - r.k) < 30


def test_language(spark, empty):
    english, german = "the quick brown fox jumps over the lazy dog and runs away ", "der schnelle braune fuchs springt über den faulen hund und läuft "
    data = [(i, (english if i % 2 else german) * 5, ("en" if i % 2 else "de") if i != 7 else "de", "host", "clash") for i in range(60)]
    data += [(100, None, "en", "host", "c"), (101, "", None, None, "c"), (102, "12 34 !!", "en", None, "c"), (103, "漢字" * 300, None, "host", "c")]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, language string")).collect()}
    assert len(found) == len(data)
    assert all(found[i].language == ("en" if i % 2 else "de") and found[i].kept for i in range(60))
    assert not any(found[i].kept for i in (100, 101, 102, 103))
    assert language.identify(empty).count() == 0


def test_language_posterior_against_brute_force(spark):
    import math

    words = {"en": "the quick brown fox jumps over the lazy dog ", "de": "der schnelle braune fuchs über den faulen hund ", "fr": "le renard brun saute par dessus le chien "}
    rng = np.random.default_rng(8)
    data = []
    for i in range(90):
        own = str(rng.choice(list(words)))
        said = own if rng.random() < 0.8 else str(rng.choice([*words, "xx"]))
        host, suffix = str(rng.choice(["a.de", "b.de", "c.com", "d.fr"])), None
        data.append((i, words[own] * int(rng.integers(1, 3)), None if i % 9 == 0 else said, None if i % 11 == 0 else host, suffix))
    data += [(900, "12 !!", "en", "a.de", None), (901, None, "en", "a.de", None), data[5]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, x string")
    label = F.substring_index("source", ".", -1)
    models = language.fit(df)
    names = models.languages
    n = len(names)
    scored = {r.doc_id: r for r in language.likelihoods(df.select("doc_id", "text"), models).collect()}
    got = language.identify(df, models=models, suffix=label).collect()
    tops = {i: int(np.argmax(r.log_l)) if r.n_grams else n - 1 for i, r in scored.items()}
    count, up, whole, said = Counter(), Counter(), Counter(), Counter()
    for i, _, lang, host, _ in data:
        k, end = tops[i], host and host.rpartition(".")[2]
        count[host, k] += 1
        up[end, k] += 1
        whole[k] += 1
        said[k, lang] += lang in names
    assert len(got) == len(data)
    for r in got:
        i, _, lang, host, _ = next(x for x in data if x[0] == r.doc_id)
        if not scored[i].n_grams:
            assert (r.language, r.kept) == ("und", False)
            continue
        end, logs = host and host.rpartition(".")[2], []
        for k in range(n):
            common = (whole[k] + 1) / (sum(whole.values()) + n)
            above = (up[end, k] + language.SUFFIX_WEIGHT * common) / (sum(up[end, j] for j in range(n)) + language.SUFFIX_WEIGHT)
            prior = (count[host, k] + language.HOST_WEIGHT * above) / (sum(count[host, j] for j in range(n)) + language.HOST_WEIGHT)
            rate = 1.0
            if lang in names:
                first = language.DECLARED_RIGHT if lang == names[k] else (1 - language.DECLARED_RIGHT) / max(1, n - 1)
                rate = (said[k, lang] + language.DECLARED_WEIGHT * first) / (sum(said[k, e] for e in names) + language.DECLARED_WEIGHT)
            logs.append(scored[i].log_l[k] + math.log(prior) + math.log(rate))
        best = int(np.argmax(logs))
        assert r.language == names[best] and abs(r.probability - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-5


def test_language_sample_is_bounded(spark):
    data = [(7, "the same text again and again", "en")] * 3000 + [(k, f"der text nummer {k} ist kurz", "de") for k in range(3000)] + [(k, "un texte rare", "fr") for k in range(2)]
    models = language.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), sample=50)
    assert models.languages == ("de", "en", "fr", "und")


def test_quality(docs, empty, rows):
    texts = {r[0]: r[1] or "" for r in rows}
    got = quality.apply(quality.ledger(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id]
        w = WORD.findall(text)
        windows: dict[tuple, list[int]] = {}
        for i in range(len(w) - 7):
            windows.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.ablations(quality.ledger(docs)).count() == len(quality.POLICIES[quality.CURRENT].rules)
    assert quality.ledger(empty).count() == 0


def test_personal_data(docs, empty, rows):
    texts = {r[0]: r[1] or "" for r in rows}
    got = pii.find(docs.select("doc_id", "text")).withColumn("clean", pii.redact(F.col("text"), F.col("spans"))).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        assert [tuple(s) for s in r.base] == _base_spans(texts[r.doc_id])
        assert (r.text == r.clean) == (not r.spans)
    assert pii.find(empty.select("doc_id", "text")).count() == 0


def test_personal_data_of_a_known_context(spark):
    known = [(i, f"please dial +1 (555) 010-{4000 + i} today or write") for i in range(8)]
    unseen = [(50, "please dial 5550109999 today or write"), (51, "invoice 5550108888 of may")]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame([*known, *unseen], "doc_id long, text string")).collect()}
    assert found[50] == [(12, 3, 22)] and found[51] == [] and all(len(found[i]) == 1 for i in range(8))


def test_personal_data_with_blanks_and_one_sided_contexts(spark):
    names = ["ann", "bob", "cid", "dan", "eve", "fay", "gus", "hal", "ida", "jon"]
    known = [(i, f"please dial +1 (555) 010-{4000 + i} today or write") for i in range(10)]
    known += [(20 + i, f"then ring +1 (555) 011-{4000 + i} {n} said") for i, n in enumerate(names)]
    known += [(40 + i, f"{n} has 4111 1111 1111 {x} expired") for i, (n, x) in enumerate(zip(names, ["1111", "1129", "1137", "1145", "1152", "1160", "1178", "1186", "1194", "1202"], strict=True))]
    unseen = {
        100: ("dial (555) 010-9999 today", [(5, 3, 19)]), 101: ("dial 555 010 9999 today.", [(5, 3, 17)]), 102: ("we ring 555.010.9998 twice", [(8, 3, 20)]),
        103: ("kim has 4303 6245 6212 1775 expired", [(8, 2, 27)]), 104: ("dial 555 010 9997 12 times", [(5, 3, 17)]), 105: ("form 555 010 9996 of may", []),
    }
    data = [*known, *((k, t) for k, (t, _) in unseen.items())]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(len(found[i].base) == 1 for i, _ in known)
    assert {k: [tuple(s) for s in found[k].spans] for k in unseen} == {k: spans for k, (_, spans) in unseen.items()}


def test_personal_data_in_contexts_with_more_unseen_than_known(spark):
    data = [(i, f"please dial +1 (555) 010-{4000 + i} today or write") for i in range(3)]
    data += [(100 + i, f"please dial 555010{6000 + i} today or write") for i in range(8)]
    # the same with words in the place of identifiers: of no kind, so they speak against the context
    data += [(200 + i, f"now call +1 (555) 011-{4000 + i} again or write") for i in range(3)]
    data += [(300 + i, f"now call {w} again or write") for i, w in enumerate(("5550119999", "me", "him", "us"))]
    # and with known identifiers of another kind
    data += [(400 + i, f"contact +1 (555) 012-{4000 + i} soon or write") for i in range(3)] + [(410 + i, f"contact a{i}@b.org soon or write") for i in range(3)] + [(420, "contact 5550129999 soon or write")]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(found[100 + i] == [(12, 3, 22)] for i in range(8))
    assert all(found[i] == [] for i in (300, 301, 302, 303, 420))


def test_counts(docs, empty, rows):
    encode = tokens.encoder()
    texts = {r[0]: r[1] or "" for r in rows}
    for r in tokens.edit_counts(tokens.sample_edits(docs)).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == len(encode(text))
        n = len(text)
        for k in (3, 2, 1):
            text = text[: n * k // 4] + " [edited]" + text[n * k // 4 + 5 :]
        assert r.n_tokens_edited == len(encode(text))
        usual = n >= 2000 and max(map(len, re.split(r"\s", texts[r.doc_id]))) < 30
        assert r.encoded_chars == n and (not usual or r.reencoded_chars < n / 20)
    assert tokens.edit_counts(tokens.sample_edits(empty)).count() == 0


def test_kept_trees_take_the_next_edits(docs, rows):
    encode = tokens.encoder()
    kept = tokens.apply_edits(tokens.trees(tokens.sample_edits(docs)))
    again = tokens.apply_edits(tokens.sample_edits(kept.select("doc_id", "text", "chars", "tokens", "encoded_chars")))
    for r in again.collect():
        assert r.n_tokens_edited == len(encode(r.text)) and r.text.count("[edited]") >= 3


def test_count_tree_under_random_edits():
    encode, lengths, rng = tokens.encoder(), tokens.byte_lengths(), np.random.default_rng(3)
    text = _sentence(9, 300) + "  \n 12 it's \x1c!x\u00a0\u3000 e\u0301\U0001f600"
    tree = tokens.CountTree(*tokens.leaf_counts(text, encode(text), lengths))
    for k in range(300):
        a = int(rng.integers(0, len(text) + 1))
        b = min(len(text), a + int(rng.integers(0, 60))) if k != 150 else len(text)
        a = 0 if k == 150 else a
        new = str(rng.choice(["", " ", "x", "\n\n", " it's 7", "word " * 20, "\u3000", "\x1d 5"]))
        after, _ = tree.replace(text, a, b, new, encode, lengths)
        text = text[:a] + new + text[b:]
        assert after == text and tree.total == len(encode(text)) and tree.chars[1] == len(text)


def test_ids_are_those_of_the_tokenizer_file(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    it = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    it.encode_special_tokens = True
    for text in [r[1] or "" for r in rows] + ["<|endoftext|> it's", "  a \n\n b\t"]:
        assert tokens.encoder()(text).tolist() == it.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [1, 3000])
def test_suffix_deduplication(docs, empty, rows, hot):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    expected = Counter()
    for r, b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        expected[(r[0], len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    got = Counter(map(tuple, suffixes.deduplicate(docs, hot).drop("kept", "n_passage_windows").collect()))
    assert got == expected
    if hot == 3000:
        assert suffixes.deduplicate(empty).count() == 0


def test_packing(docs, empty, rows):
    got = packing.pack(packing.pieces(docs)).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    bins: dict[int, list] = {}
    for r in got:
        ids = np.append(tokens.encoder()(texts[r.doc_id]), 0).astype("<u4")[r.start : r.start + r.length]
        assert len(ids) == r.length <= 2048 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert total == sum(len(tokens.encoder()(r[1] or "")) + 1 for r in rows) and len(bins) <= -(-total // 2048) + 1
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_best_fit_obeys_every_limit():
    lengths = np.array([5, 4, 3, 3, 2, 1, 1, 1])
    for score in ("norm", "dot"):
        where, _ = packing.best_fit(lengths, 8, 2, 40, score=score)
        for b in set(where):
            own = lengths[where == b]
            assert own.sum() <= 8 and len(own) <= 2 and (own**2).sum() <= 40


def test_media(docs, empty, rows):
    texts = {r[0]: r[1] or "" for r in rows}
    got = gif.digests(gif.stored(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        p = gif.payload_of(texts[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert len(p) % 576 == 0 and len(p) > 0 and r.n_bytes == len(texts[r.doc_id].encode())
    assert gif.digests(gif.stored(empty)).count() == 0
    assert gif.frames(gif.stored(docs)).groupBy("doc_id").count().count() == len({r[0] for r in rows})


def _lzw(samples: bytes, bits: int) -> bytes:
    """A compressing encoder, to test the decoder's table."""
    clear, out, width = 1 << bits, [], bits + 1
    table, at = {bytes([k]): k for k in range(clear)}, (1 << bits) + 2
    out.append((clear, width))
    w = b""
    for c in samples:
        if w + bytes([c]) in table:
            w += bytes([c])
            continue
        out.append((table[w], width))
        if at < 4096:
            table[w + bytes([c])] = at
            if at == 1 << width and width < 12:
                width += 1
            at += 1
        w = bytes([c])
    out += [(table[w], width)] if w else []
    if at == 1 << width and width < 12:
        width += 1
    out.append((clear + 1, width))
    total, shift = 0, 0
    for code, n in out:
        total |= code << shift
        shift += n
    return total.to_bytes(-(-shift // 8), "little")


def test_stored_gifs_are_compressed_and_hold_any_bytes():
    rng = np.random.default_rng(5)
    for payload in (b"a" * 57600, rng.integers(0, 256, 57600).astype(np.uint8).tobytes(), (b"to be or not " * 5000)[:57600]):
        data = gif.encode(payload)
        assert b"".join(np.ascontiguousarray(f.palette[f.samples.ravel(), 0]).tobytes() for f in gif.decode(data)) == payload
        assert _lzw(payload[: 64 * 576], 8) and (payload[0] != 97 or len(data) < 4000)
    first, second = (f.canvas for f in gif.decode(gif.encode(b"a" * 64 * 576 + b"b" * 64 * 576)))
    assert (first[..., 0] == 97).all() and (second[..., 0] == 98).all()


def test_gif_streams_palettes_and_disposal():
    rng = np.random.default_rng(0)
    for bits, top in ((2, 4), (8, 256)):
        samples = np.repeat(rng.integers(0, top, 4000), rng.integers(1, 4, 4000)).astype(np.uint8).tobytes()
        assert gif.unpack_codes(_lzw(samples, bits), bits, len(samples)).tobytes() == samples
    head = b"GIF89a" + b"\x02\x00\x02\x00\xf0\x00\x00" + bytes([255, 0, 0, 0, 0, 255])

    def frame(samples, disposal, clear=None, local=b"", interlaced=False, size=(0, 0, 2, 2)):
        flags = disposal << 2 | (clear is not None)
        control = b"\x21\xf9\x04" + bytes([flags, 7, 0, clear or 0, 0])
        where = b"".join(x.to_bytes(2, "little") for x in size)
        data = _lzw(bytes(samples), 2)
        return control + b"\x2c" + where + bytes([(0x80 if local else 0) | (0x40 if interlaced else 0)]) + local + b"\x02" + bytes([len(data)]) + data + b"\x00"

    data = head + frame([0, 1, 1, 0], 1) + frame([1, 0, 0, 1], 3, clear=0) + frame([1], 2, size=(1, 1, 1, 1), local=bytes([0, 255, 0, 9, 9, 9])) + frame([1, 1, 1, 1], 0, clear=1, interlaced=True) + b"\x3b"
    seen = [(f.delay_ms, f.canvas) for f in gif.decode(data)]
    red, blue = [255, 0, 0, 255], [0, 0, 255, 255]
    assert [d for d, _ in seen] == [70] * 4
    assert seen[0][1].tolist() == [[red, blue], [blue, red]]
    assert seen[1][1].tolist() == [[blue, blue], [blue, blue]]
    assert seen[2][1].tolist() == [[red, blue], [blue, [9, 9, 9, 255]]]  # the second frame was undone
    assert seen[3][1].tolist() == [[red, blue], [blue, [0, 0, 0, 0]]]  # the third was cleared, the fourth is invisible
    with pytest.raises(ValueError):
        list(gif.decode(data[:30]))


def test_passages_of_other_documents(spark, docs, rows):
    def of(data):
        words = {r[0]: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in data}
        where: dict[tuple, set] = {}
        for i, w in words.items():
            for k in range(len(w) - 50):
                where.setdefault(tuple(w[k : k + 51]), set()).add(i)
        return {i: sum(len(where[tuple(w[k : k + 51])]) > 1 for k in range(len(w) - 50)) for i, w in words.items()}

    shared = " ".join(f"w{k}" for k in range(55))
    data = [(i, f"{_sentence(300 + i, 40 + i)}\n{shared if i % 2 else shared.upper()}\t{_sentence(400 + i, 30)}") for i in range(6)]
    data += [(10, f"{shared} {_sentence(9, 9)} {shared}"), (11, _sentence(12, 70) + " " + _sentence(12, 70))]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    for table, given in ((docs, rows), (frame, data)):
        got, wanted = suffixes.deduplicate(table).collect(), of(given)
        assert all(r.n_passage_windows == wanted[r.doc_id] for r in got)


def test_near_copies_are_not_expanded_into_pairs(spark, monkeypatch):
    seen, plain = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    rng, base = np.random.default_rng(4), _sentence(1, 200).split()
    texts = [" ".join(base)]
    for _ in range(159):
        own = list(base)
        for k in rng.integers(0, 200, 3):
            own[k] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(own))
    order = rng.permutation(160)  # the text that all were made from has any id
    got = jaccard.join(spark.createDataFrame([(int(i), t) for i, t in zip(order, texts, strict=True)], "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}
    assert sum(seen) < 4 * 160


def test_jaccard(docs, empty, rows):
    sets = {}
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    name = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and name[a] < name[b]:
                    name[b], changed = name[a], True
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(k, len(s), name[k]) for k, s in sets.items()}
    assert jaccard.join(empty).count() == 0


def test_jaccard_tiles(spark):
    words = _sentence(20, 120).split()
    rng = np.random.default_rng(5)
    texts = []
    for i in range(60):
        own = list(words)
        for k in rng.choice(120, 5, replace=False):
            own[k] = f"w{i}x{k}"
        texts.append((i, " ".join(own), "s"))
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(4)
    a = {tuple(r) for r in jaccard.join(frame, percent=60).collect()}
    assert a == {tuple(r) for r in jaccard.join(frame, percent=60, tile_rows=5).collect()}


def test_count_tree_search_misses_nothing():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(200, 300)], rng.integers(1, 1 << 62, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(80)]
    at = np.array([jaccard.folded(jaccard.point(s), jaccard.GROUPS) for s in sets])
    n = np.array([len(s) for s in sets])
    tree = jaccard.CountTree(n, at, np.full(80, 1 << 20), np.arange(80))
    for k, s in enumerate(sets):
        near = set(tree.search(int(n[k]), at[k], 1 << 20, k).tolist())
        for j, t in enumerate(sets):
            if j != k and len(np.intersect1d(s, t)) * 100 >= 80 * len(np.union1d(s, t)):
                assert j in near


def test_warc(spark):
    pages = [(1, "http://a.b/c", "<html lang=en><title>T\nx</title><script>var a='<p>'</script><p>One &amp; two<br>é</p><!-- no --></html>"), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "http://x", "< <<< &lt;b&gt;")]
    records = warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string")))
    got = records.collect()
    assert len(got) == 10 and Counter(r.warc_type for r in got) == {"metadata": 5, "conversion": 5}
    text = {r.page_id: r for r in got if r.warc_type == "conversion"}
    assert text[1].content == "T x\nOne & two\né" or text[1].content == "T\nx\nOne & two\né"
    assert text[4].content == "< <<< <b>" and text[2].content == ""
    for r in got:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.content.encode()).hexdigest() and r.refers_to.startswith("<urn:uuid:")
    back = warc.parse(warc.serialize(records).select(F.col("warc").alias("content"))).collect()
    assert Counter((b.record_id, bytes(b.block).decode()) for b in back) == Counter((r.record_id, r.content) for r in got)


def test_warc_titles_are_whole(spark):
    title = "é word " * 300 + "end"
    pages = spark.createDataFrame([(1, "u", f"<title>{title}</title>x")], "page_id long, url string, html string")
    meta = warc.derivatives(warc.responses(pages)).filter("warc_type = 'metadata'").first()
    assert meta.content.startswith(f"title: {title}\r\n") and meta.content_length == len(meta.content.encode())


def test_warc_bytes_with_responses(spark):
    html = b"<html lang=en><title>T</title><p>One &amp; two</html>"
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=ascii\r\nX-A: 1\r\n 2\r\nX-A: 3\r\n\r\n"

    def record(kind, block, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Target-URI: http://a.b/", "WARC-Date: 2020-01-02T03:04:05Z", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    data = record("warcinfo", b"a: b") + record("response", http + html, "WARC-Payload-Digest: sha1:ABC", "WARC-IP-Address: 1.2.3.4") + record("response", html)
    data += record("response", http.replace(b"\r\n", b"\n") + html)
    out = warc.derivatives(warc.parse(spark.createDataFrame([(data,)], "content binary")))
    got = out.collect()
    assert Counter(r.warc_type for r in got) == {"metadata": 3, "conversion": 3}
    assert {r.content for r in got if r.warc_type == "conversion"} == {"T\nOne & two"}
    own = "sha256:" + hashlib.sha256(html).hexdigest()
    assert Counter((r.target_uri, r.warc_date, r.refers_to) for r in got) == {("http://a.b/", "2020-01-02T03:04:05Z", "<urn:uuid:1>"): 6}
    assert Counter((r.source_content_type, r.source_payload_digest) for r in got) == {("text/html; charset=ascii", "sha1:ABC"): 2, (None, own): 2, ("text/html; charset=ascii", own): 2}
    lines = next(r.content for r in got if r.warc_type == "metadata" and r.source_payload_digest == "sha1:ABC").split("\r\n")
    assert {"source-http-status: HTTP/1.1 404 Not Found", "source-http-x-a: 1 2", "source-http-x-a: 3", "source-warc-warc-ip-address: 1.2.3.4", "source-content-type: text/html; charset=ascii"} <= set(lines)
    assert warc.parse(warc.serialize(out).select(F.col("warc").alias("content"))).count() == 6


def test_pipeline_keeps_ids_and_packs(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("size", "p", "h", "node", "spans", "base", "n").write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert out.count() > 0 and out.filter("doc_id is null").count() == 0
        out.write.parquet(str(tmp_path / name))
        before, at = at, spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id for r in at.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_pipeline_treats_rows_without_ids_and_with_one_id_alike(spark):
    import corpus_pipeline

    def frame(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    english, german = "the quick brown fox jumps over the lazy dog and runs away ", "der schnelle braune fuchs springt über den faulen hund und läuft "
    known = [(i, (english, german)[i % 2] * 5, ("en", "de")[i % 2], "s", 1) for i in range(40)]
    lost = [(None, english * 6, "en", "s", 1), (None, german * 6, None, "s", 1), (None, "12 34", "en", "s", 1), (3, "12 34", "de", "s", 1)]
    got = corpus_pipeline.language_stage(spark, frame(known + lost), "").collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in got) == Counter((i, t, la) for i, t, la, *_ in known) + Counter({(None, english * 6, "en"): 1, (None, german * 6, "de"): 1})

    a, b, c = (_sentence(k, 60) for k in (70, 71, 72))
    rows = [(5, a, "en", "s", 1), (5, a, "en", "s", 1), (7, a + " more", "en", "s", 1), (7, b, "en", "s", 1), (6, b + " more", "en", "s", 1), (None, c, "en", "s", 1), (None, c + " more", "en", None, 1), (None, c, "en", "s", 1), (None, b, "en", "s", 1)]
    got = corpus_pipeline.near_duplicate_stage(spark, frame(rows), "").collect()
    assert len(got) == 3 and {(r.doc_id, r.text) for r in got} >= {(5, a), (6, b + " more")}
    assert sum(r.doc_id is None and r.text.startswith(c) for r in got) == 1

    many = [(i // 3 if i % 5 else None, f"w{i} " * (1 + i % 9), "en", "s" if i % 4 else None, 1) for i in range(600)]
    many += many[:50]
    taken = {r.source: r.target for r in mixing.mix(frame(many)).collect()}
    got = corpus_pipeline.mixture_stage(spark, frame(many), "").collect()
    for source, target in taken.items():
        assert abs(sum(len(r.text.split()) for r in got if r.source == source) - target) < 30
    assert any(r.doc_id is None for r in got) and all(k <= 2 * Counter(map(tuple, many))[r] for r, k in Counter(map(tuple, got)).items())
