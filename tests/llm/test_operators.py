"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quadrille.llm import bpe, decontamination, html_extraction, language_id, license_scan, media, near_dedup, pii, quality, substring_dedup

R = random.Random(3)
WORDS = [f"w{k}" for k in range(400)]


def words(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE, PASSAGE = words(60), words(55)
TEXTS = [None, "", " \t\n", "one", BASE, BASE, BASE.upper(), BASE + " tail", words(40) + " " + PASSAGE + " " + words(40), PASSAGE + " x", words(3000), "Émile à Köln, ß 中文 " + BASE, "a b c", "A b  c"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(TEXTS)] + [(4, BASE, "en", "s", len(BASE))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("text_sha", F.lit(1)).withColumn("row", F.lit("x"))


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_near_duplicates(docs):
    sets = {k: shingles(t, 4) for k, t in enumerate(TEXTS)}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 4).collect()}
    assert got == {k: (len(sets[k]), root[k], root[k] == k) for k in sets}


def test_substring_dedup(docs):
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in enumerate(TEXTS)}
    first = {}
    for k in sorted(split):
        for i in range(len(split[k]) - 49):
            first.setdefault(tuple(split[k][i : i + 50]), k)
    want = {}
    for k, w in split.items():
        gone = {p for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < k for p in range(i, i + 50)}
        want[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 100
    spans = substring_dedup.against_reference(docs.where("doc_id = 9"), docs.where("doc_id = 8")).collect()
    assert [(r.start, r.end) for r in spans] == [(0, 55)]


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE), (2, "a B c"), (3, None), (None, "zzz"), (2, "a b c")], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontamination.report(docs, items).collect()}
    assert got[8].n_hit == 55 and got[8].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert got[12].n_hit == 3 and got[12].n_items == 1 and not got[0].contaminated and got[0].n_words == 0
    kept = {r.doc_id: r.text for r in decontamination.remove(docs, items).collect()}
    assert 9 not in kept and 12 not in kept and PASSAGE not in kept[8] and kept[10] == TEXTS[10]
    assert not any(r.contaminated for r in decontamination.report(docs, items.where("false")).collect())


def test_bpe(docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding(), t.no_truncation()
    b = bpe.load(bpe.vocabulary_path())
    odd = ["<|endoftext|> a<|startoftext|>", "ΣΑΣ ŉ İ", "x" * 300, "don't I'LL 12345", "  á", "🙂🙂 \x00"]
    for text in [x or "" for x in TEXTS] + odd:
        ids = t.encode(text, add_special_tokens=False).ids
        assert b.encode(text) == ids and b.decode(ids) == t.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r.n_tokens for r in bpe.report(docs).collect()}
    assert got[0] == 0 and got[4] == len(b.encode(BASE))


def test_pii():
    text = "mail a.b+c@x-y.example.org, 10.0.0.256 10.0.0.1, 4111 1111 1111 1111 or +1 (212) 555-0100 ext"
    kinds = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
    assert kinds == [("email", "a.b+c@x-y.example.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100")]
    (base, _), (none, more) = pii.all_spans([text, ""], pii.model())
    assert base == pii.base_spans(text) and not none and not more
    assert "[EMAIL]" in pii.redacted(text, base) and "a.b+c" not in pii.redacted(text, base)


def test_pii_held_out():
    rows = pii.labelled(seed=99, rows=80)
    crf = pii.model()
    pairs = [(crf.labels[g], w) for (ws, gold), path in zip(rows, crf.decode([pii._features(w) for w, _ in rows]), strict=True) for g, w in zip(path, gold, strict=True)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.97


def test_html():
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n two <b>three</b> words here.<p>Next, more of it.</article><div class='comments'><p>nice post</p></div><footer>&copy; me</footer><script>var x = '<p>no</p>'</script>"
    assert html_extraction.extract([page, None, "", "<p", "<!--"], html_extraction.model()) == ["A & B\nOne two three words here.\nNext, more of it.", "", "", "", ""]


def test_media(docs):
    for text in TEXTS:
        payload = media.payload_of(text)
        stored = media.store(payload)
        assert media.restore(stored)[0] == payload and len(payload) % 64 == 0 and payload
        broken = bytearray(stored)
        broken[len(broken) // 2] ^= 1
        with pytest.raises(ValueError):
            media.restore(bytes(broken))
    r = media.report(docs.where("doc_id = 3")).first()
    assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (3, 64, zlib.crc32(b"one" + bytes(61)))


def test_license(spark):
    rows = [(1, "x Under the MIT-license. cc by nc y under THE mit license"), (2, None), (3, "Apache License, Version 2.0"), (4, "sunder the mit license"), (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (2, "")]
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got[0] == (1, 13, 3, 1, 9, "cc-by-nc,mit", "cc-by-nc,mit") and got[1] == got[2] == (2, 0, 0, None, None, "", "")
    assert got[3][:4] == (3, 5, 1, 0) and got[4][5] == "" and got[5][5:] == ("", "mit")


def test_language(spark):
    kinds = {lang: ["".join(R.choice(signs) for _ in range(6)) for _ in range(60)] for lang, signs in (("aa", "abcdefgh"), ("bb", "stuvwxyz"))}
    rows = [(k, " ".join(R.choice(kinds[lang]) for _ in range(40)), lang) for k in range(120) for lang in [("aa", "bb")[k % 2]]] + [(500, None, "aa"), (501, "123 --", None), (502, "", "bb")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in language_id.report(docs, language_id.learn(docs)).collect()}
    assert all(out[k].lang_pred == lang for k, _, lang in rows[:120]) and [out[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in out)
    assert {r.lang_pred for r in language_id.report(docs, {}).collect()} == {"und"}


def test_language_of_long_text():
    kinds = {lang: ["".join(R.choice("etaoinshrdlu") for _ in range(6)) for _ in range(2000)] for lang in ("aa", "bb")}
    say = lambda lang, n: " ".join(R.choice(kinds[lang]) for _ in range(n // 7))
    taught = tuple((lang, say(lang, 64 << 10).encode()) for lang in kinds)
    assert language_id.predict(say("aa", 20_000) + " " + say("bb", 1_000_000), taught)[0] == "bb"
    assert all(language_id.predict(say(lang, 3_000_000), taught)[::2] == (lang, False) for lang in kinds)


def test_quality(spark):
    rows = [(k, words(30) + (" !!! $$$" * 5 if k % 3 == 0 else "."), int(k % 3 != 0)) for k in range(150)] + [(900, None, 1), (901, "", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in quality.report(docs, quality.learn(docs, labels)).collect()}
    held = [(out[k].predicted, y) for k, _, y in rows[:150] if out[k].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.9 and out[900].score == out[901].score
    assert {r.score for r in quality.report(docs, quality.learn(docs, labels.where("false"))).collect()} == {0.5}


def test_quality_learns_from_whole_texts(spark):
    head = words(2500)
    rows = [(k, head + (" !!! $$$" * 400 if k % 2 else " " + words(800)), int(k % 2 == 0)) for k in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id bigint, quality int, toxic int")
    assert len(head) > 8192
    out = {r.doc_id: r.score for r in quality.report(docs, quality.learn(docs, labels)).collect()}
    assert min(out[k] for k, _, y in rows if y) > max(out[k] for k, _, y in rows if not y) + 0.5
