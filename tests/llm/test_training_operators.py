"""Training-data operators against brute force on small rows with the awkward cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hammerline.llm import language, licenses, lzprint, mixing, neardup, packing, quality, substrings, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 160))) for _ in range(60)]
    shared = " ".join(rng.choice(words) for _ in range(70))
    near = base[5].split() + ["tail"] * 2
    near[len(near) // 2] = "changed"
    more = [base[7], base[7], " ".join(near), shared + " " + base[1], base[2] + "\n" + shared, None, "", " \n\t", "A", "one two", " ".join(rng.choice(words) for _ in range(6000)), base[9] + "\n" + base[9], "All rights reserved.\nReleased under the MIT License", "Ünï cc-BY çà"]
    return dict(enumerate(base + more))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, ("en", None)[i % 9 == 0], f"s{i % 3}", len(t or ""), "x") for i, t in texts.items()], SCHEMA)


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    want = {}
    for i, t in texts.items():
        ids = np.asarray([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = packing.pack(docs, path).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(v[1] for v in want.values()) // 2048) + 1
    assert packing.pack(docs.limit(0), path).count() == 0


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(np.minimum(rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1, 2048), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    classes = packing.plan_classes(histogram)
    back = {}
    for held, times in classes:
        assert sum(n * c for n, c in held) <= 2048
        for n, c in held:
            back[n] = back.get(n, 0) + c * times
    assert back == histogram
    assert sum(t for _, t in classes) <= 1.01 * sum(n * c for n, c in histogram.items()) / 2048 + 2


def test_substrings(docs, texts):
    split = {i: (t or "").encode().split() for i, t in texts.items()}
    owner = {}
    for i, w in split.items():
        for k in range(len(w) - 49):
            owner.setdefault(tuple(w[k : k + 50]), i)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, 50).collect()}
    removed = 0
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if owner[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        assert (got[i]["_n_words"], got[i]["_n_removed"], got[i]["_kept_text"]) == (len(w), sum(gone), kept)
        removed += sum(gone)
    assert removed > 50


def test_near_duplicates(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(neardup.LOWER).split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 4, 80).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://A.example.org/x?b=1", "<p>one</p>"), (2, "https://b.example.org:8443/", "two\r\n\r\nthree"), (3, None, None), (4, "http://a.example.org/x?b=1", "<p>one</p>"), (5, "http://[bad", ""), (6, "http://c.example.org", "é")]
    index = warc.CaptureIndex.build(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}")
    groups = {}
    for i, _, h in pages:
        groups.setdefault((h or "").encode(), []).append(i)
    want = {i: (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if i == max(v) else "revisit", None if i == max(v) else max(v)) for h, v in groups.items() for i in v}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.records().collect()} == want
    assert {f["WARC-Type"] for f in index.lookup("http://a.example.org/x?b=1")} == {"response", "revisit"}
    assert index.lookup("http://nowhere.example.org/") == []


def held_templates(words, templates=licenses.TEMPLATES):
    """Labels by brute force: every run of template pairs against every template."""
    sets = [(label, set(licenses.pairs_of(t))) for label, t in templates]
    every = set().union(*(t for _, t in sets))
    blocks, last = [], None
    for k in range(len(words) - 1):
        pair = f"{words[k]} {words[k + 1]}"
        if pair in every:
            if last is None or k - last > licenses.BREAK:
                blocks.append(set())
            blocks[-1].add(pair)
            last = k
    return {label for label, t in sets for x in blocks if len(x & t) >= 0.85 * len(t) - 1e-9}


def test_licenses(docs, texts):
    for r in licenses.scan(docs).collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id] or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert r.n_words == len(w) and sorted((x["at"], x["label"]) for x in r.places) == sorted(places)
        more = held_templates(w)
        assert set(r.labels) == more | {label for _, label in places}


def test_quality(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    for r in quality.judge(docs, labels).collect():
        w = (texts[r.doc_id] or "").encode().split()
        seen, covered = {}, [False] * len(w)
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        for ks in seen.values():
            for k in ks if len(ks) > 1 else []:
                covered[k : k + 8] = [True] * 8
        assert (r.n_words, r.n_repeat_words) == (len(w), sum(covered))
        assert r.kept == (not r.base_failed)  # too few labels certify nothing


def test_binomial_tail(spark):
    from math import comb

    rows = spark.createDataFrame([(0, 100), (2, 300), (30, 100)], "k long, n long")
    for r in rows.withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect():
        exact = sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(1.0 if r.k >= r.n * 0.02 else exact, rel=1e-9)


def test_language(spark):
    rows = [(i, t, lang) for i in range(20) for lang, t in (("en", "the thing that they then thought of with them"), ("de", "der schöne und nicht ganz schlechte ich"))]
    docs = spark.createDataFrame([*rows, (99, None, None), (98, "12 !?", "en"), (97, "then they thought", None)], "doc_id long, text string, lang string")
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.predict(docs, language.train(docs)).collect()}
    assert got[99, None] == ("und", 0.0) and got[98, "12 !?"][0] == "und" and got[97, "then they thought"][0] == "en"
    assert all(got[i, t][0] == lang for i, t, lang in rows)


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = [rng.choice("lorem ipsum dolor sit amet sed do magna aliqua".split()) for _ in range(30)] + (["vile"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    models = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), [1 - F.col("toxic") * 0, F.col("toxic")])
    got = {r.doc_id: r.toxic for r in toxicity.predict(docs, models, ["any", "toxic"]).collect()}
    assert all(got[i] == bool(t) for i, t in labels) and not got[1000] and not got[1001]


def test_mixing(spark, docs):
    shares = {"a": 0.9, "b": 0.1}
    t = mixing.exponent_for(shares, max_repeats=1.5)
    assert max(mixing.epochs_at(shares, t, None).values()) == pytest.approx(1.5, abs=1e-6)
    t = mixing.exponent_for(shares, target_entropy=0.5)
    assert mixing.entropy(mixing.weights_at(shares, t)) == pytest.approx(0.5, abs=1e-6)
    rows = mixing.mix(docs).collect()
    assert {r.doc_id for r in rows} == set(range(docs.count())) and all(0 <= r["_mix_key"] <= 1 for r in rows)


def test_fingerprints(docs, texts):
    make, order = lzprint.Fingerprinter(), sorted(texts)
    prints = {i: lzprint.packed(make(texts[i] or "")[0]) for i in order}
    got = {r.doc_id: r for r in lzprint.edited_likeness(docs).collect()}
    for at, i in enumerate(order):
        t, nxt = texts[i] or "", order[(at + 1) % len(order)]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + (texts[nxt] or "")[:cut]
        other = lzprint.packed(make(edited)[0])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[i], other)
        assert (r.near_edited, r.near_next) == (lzprint.likeness(prints[i], other), lzprint.likeness(prints[i], prints[nxt]))
    assert prints[60] == prints[61]
