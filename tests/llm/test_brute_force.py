"""Language ID, toxicity chain, fingerprints and the pipeline against plain Python that shares no step with them."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hammerline.llm import language, lzprint, mixing, neardup, packing, toxicity, warc

public_tokenizers = pytest.importorskip("public_tokenizers")


def grams(text):
    """Counts of n-gram hashes, letter by letter."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    out = Counter()
    # white space that two words share is one mark, so single marks count once a gap and at both ends
    line = "\0" + "\0".join(words) + "\0" if words else ""
    for n in (1, 2, 3, 4):
        for k in range(len(line) - n + 1):
            g = line[k : k + n]
            if n == 1 and g == "\0" or "\0" in g[1:-1]:
                continue
            h = n
            for c in g:
                h = (h * 0x01000193 + (0 if c == "\0" else ord(c)) * 0x9E3779B1) % 2**32
            out[h ^ (h >> 15)] += 1
    return out


def rank(counts, most=400):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most])}


def classify(text, profiles):
    own = rank(grams(text))
    if not own or not profiles:
        return "und", 0.0
    cost = {lang: sum(abs(p[g] - k) if g in p else 400 for g, k in own.items()) for lang, p in profiles.items()}
    best = min(sorted(cost), key=cost.get)
    return best, 1 - cost[best] / (400 * len(own))


def profiles_of(rows):
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    return {lang: rank(c) for lang, c in counts.items() if c}


def test_out_of_place_distance(spark):
    rng = random.Random(2)
    letters = {"aa": "abcdefghij", "bb": "efghijklmné", "cc": "xyzßüab"}
    rows = [(i, "".join(rng.choice(letters[lang] + "   .,1\n") for _ in range(rng.randint(0, 400))), lang) for i, lang in enumerate(rng.choices(list(letters), k=60))]
    rows += [(100, None, "aa"), (101, "", None), (102, "123 ..", "bb"), (103, "Éß", None), (5, rows[5][1], "aa"), (None, "abc abc", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(7))
    profiles = language.train(docs)
    want = profiles_of((t, lang) for _, t, lang in rows)
    assert {k: {g: i for i, g in enumerate(v)} for k, v in profiles.items()} == want
    got = sorted(((r.doc_id, r.text, r.lang_pred, r.score) for r in language.predict(docs, profiles).collect()), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in sorted(((i, t, *classify(t, want)) for i, t, _ in rows), key=str)]
    assert all(g[3] == pytest.approx(classify(g[1], want)[1]) for g in got)
    assert language.train(docs.limit(0)) == {} and language.predict(docs.limit(0), {}).count() == 0
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}


def test_chain_feeds_out_of_fold_probabilities():
    """The second category depends on the first alone; the weight of the chain and its inputs show it."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        first = rng.random() < 0.5
        rows.append(np.unique(np.asarray([1 if first else 2, *rng.sample(range(10, 60), 6)], np.uint32)))
        labels.append((float(first), float(first)))
    a, b = toxicity.fit_chain(rows, np.asarray(labels))
    assert a.chain == [] and len(b.chain) == 1
    # out of fold: the probabilities the second model saw come from models that never saw the row
    seen = []
    original = toxicity.fit_linear

    def spy(x, y, *args, **kwargs):
        seen.append((x, y))
        return original(x, y, *args, **kwargs)

    toxicity.fit_linear = spy
    try:
        toxicity.fit_chain(rows, np.asarray(labels))
    finally:
        toxicity.fit_linear = original
    assert len(seen) == 2 * (toxicity.FOLDS + 1)
    fold = np.arange(len(rows)) % toxicity.FOLDS
    fed = seen[-1][0][:, -1]
    for k in range(toxicity.FOLDS):
        use = np.flatnonzero(fold != k)
        y = np.asarray(labels)[use, 0]
        features = toxicity.select([rows[i] for i in use], y, toxicity.FEATURES)
        w = original(toxicity.matrix([rows[i] for i in use], features), y.astype(np.float32))
        for i in np.flatnonzero(fold == k)[:20]:
            z = sum(float(w[j]) for j, f in enumerate(features) if f in rows[i]) + float(w[-1])
            assert fed[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_scores_are_the_chain_by_hand(spark):
    models = [toxicity.Model({1: 0.5}, [], -1.0, 0.4), toxicity.Model({2: 1.5}, [3.0], -2.0, 0.5)]
    p = 1 / (1 + math.exp(-(0.5 - 1.0)))
    q = 1 / (1 + math.exp(-(3.0 * p - 2.0)))
    first = models[0].score(np.asarray([1, 9], np.uint32), [])
    assert first == pytest.approx(p) and models[1].score(np.asarray([1, 9], np.uint32), [first]) == pytest.approx(q)


def test_toxicity_without_labels_and_with_awkward_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, None), (None, "c"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, 0), (1, 1, 1), (9, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        models = toxicity.train(docs, some, [1 - F.col("quality"), F.col("toxic")])
        rows = toxicity.predict(docs, models, ["low_quality", "toxic"]).collect()
        assert len(rows) == 4 and not any(r.toxic or r.low_quality for r in rows)
    assert toxicity.predict(docs.limit(0), models, ["low_quality", "toxic"]).count() == 0


def lz78(text):
    known, phrase, out = set(), "", set()
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            out.add(phrase)
            phrase = ""
    return out | ({phrase} if phrase else set())


def test_likeness_estimates_that_of_phrase_sets():
    rng = random.Random(6)
    make, errors = lzprint.Fingerprinter(), []
    for _ in range(120):
        text = "".join(rng.choice("abcde ") for _ in range(rng.randint(200, 2000)))
        cut = rng.randint(0, len(text))
        other = text[:cut] + "".join(rng.choice("abcde ") for _ in range(len(text) - cut))
        a, b = lz78(text), lz78(other)
        got = lzprint.likeness(lzprint.packed(make(text)[0]), lzprint.packed(make(other)[0]))
        errors.append(abs(got - len(a & b) / len(a | b)))
    assert sum(errors) / len(errors) < 0.06 and max(errors) < 0.25


def test_signature_is_the_least_hash_of_each_phrase():
    text = "the cat the catalog the cathedral é𝄞"
    mask = 2**64 - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    base, least = 0x9E3779B97F4A7C15, [mask] * lzprint.PLACES
    for phrase in lz78(text):
        h = mix(sum(mix(ord(c) + 1) * pow(base, k, 2**64) for k, c in enumerate(phrase)) & mask) + len(phrase) & mask
        for k in range(lzprint.PLACES):
            least[k] = min(least[k], h * (mix((k + 1) * base & mask) | 1) & mask)
    assert lzprint.Fingerprinter()(text)[0].tolist() == least


@pytest.mark.parametrize("case", ["plain", "nulls", "hot", "few", "large"])
def test_followers_of_awkward_ids(spark, case):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(50)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
    ids = {"plain": list(range(200)), "nulls": [None] * 150 + list(range(60)), "hot": [5] * 150 + list(range(80)), "few": [3], "large": [2**62 + i for i in range(40)] + [None]}[case]
    rows = [(i, text()) for i in ids] + ([(7, None), (7, ""), (7, "")] if case == "hot" else [])
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tie = {r.text: r.tie for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("tie", F.xxhash64("text")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in lzprint.edited_likeness(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lzprint.edited_likeness(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, "else " * 9), (None, a), (9, None), (7, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 5, 80).collect()), key=str)
    one = {}
    for i, t in rows:
        if i is not None and t is not None:
            s = np.unique(neardup.Shingler(5)(t.encode()))
            one[i] = min(one.get(i, (b"\xff" * 16, None)), (hashlib.md5(s.tobytes()).digest(), t))
    least = {}
    for i in sorted(one):
        least.setdefault(one[i][1], i)
    want = sorted(((i, len(neardup.Shingler(5)((t or "").encode())), None if i is None else least[one[i][1]]) for i, t in rows), key=str)
    assert got == want


def test_lookup_reads_the_blocks_of_one_key(spark, tmp_path):
    pages = [(i, f"http://h{i % 40}.example.org/p{i % 9}", f"<p>{i % 30}</p>") for i in range(600)] + [(1000 + i, "http://hot.example.org/", str(i)) for i in range(50)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    base = f"file://{tmp_path}"
    index = warc.CaptureIndex(spark, base, warc.write_index(warc.write_archives(rows, f"{base}/archives"), f"{base}/index", block_entries=7))
    for url in ("http://h3.example.org/p3", "http://hot.example.org/", "http://h39.example.org/p8", "http://a.example.org/", "http://zz.example.org/"):
        assert len(index.lookup(url)) == sum(u == url for _, u, _ in pages)


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(150)] for lang, letters in (("en", "etaoinshr"), ("de", "enisratduü"))}
    make = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, make(lang, rng.randint(1, 300)), lang, f"s{i % 5 % 3}") for i, lang in enumerate(rng.choices(["en", "de"], k=120))]
    passage = make("en", 70)
    for i in range(200, 212):
        rows.append((i, make("en", 40) + " " + passage + "\n" + make("de", 30), "en", "s1"))
    for i in range(300, 306):
        near = rows[3 + i % 2][1].split()
        rows.append((i, " ".join([*near, f"tail{i}"]), "en", "s2"))
    rows += [(400, None, None, None), (401, "", "en", "s0"), (402, "123 ...", "en", None), (403, rows[7][1], None, None), (404, "A", "en", "s0"), (405, make("en", 9000), "en", "s1"), (406, passage, "de", None)]
    d = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("_id", F.lit("x")).withColumn("_block", F.lit(1)).withColumn("score", F.lit("y")).write.parquet(f"{d}/documents.parquet")
    return d


def test_pipeline_stage_by_stage(spark, corpus):
    import zlib

    from tokenizers import Tokenizer

    docs, held = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus).cache()
        held[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        assert name == "best-fit packing" or out.columns == list(corpus_pipeline.COLUMNS)
        docs = out
    before, after = held["language ID"]
    learnt = profiles_of((r["text"], r["lang"]) for r in before if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2)
    assert {r["doc_id"]: r["lang"] for r in after} == {r["doc_id"]: lang for r in before if (lang := classify(r["text"], learnt)[0]) != "und"}

    before, after = held["MinHash near-dedup"]
    sets = {}
    for r in before:
        w = [x.translate(neardup.LOWER) for x in words(r["text"])]
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i in sets if find(i) == i) and len(after) < len(before)

    before, after = held["substring dedup"]
    owner = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        w = words(r["text"])
        for k in range(len(w) - 49):
            owner.setdefault(tuple(w[k : k + 50]), r["doc_id"])
    want = {}
    for r in before:
        w = words(r["text"])
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if owner[tuple(w[k : k + 50])] < r["doc_id"]:
                gone[k : k + 50] = [True] * 50
        if not any(gone):
            want[r["doc_id"]] = r["text"]
        elif not all(gone):
            want[r["doc_id"]] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = held["mixing"]
    totals = Counter()
    for r in before:
        totals[r["source"]] += len(words(r["text"]))
    got, copies = Counter(), Counter(r["doc_id"] for r in after)
    for r in after:
        got[r["source"]] += len(words(r["text"]))
    most = max(totals.values())
    t = max(0.0, 1 - math.log(1.5) / math.log(most / min(totals.values())))
    assert set(copies) == {r["doc_id"] for r in before} and max(copies.values()) <= 2
    for s, n in totals.items():
        smallest_out = min((len(words(r["text"])) for r in before if r["source"] == s and copies[r["doc_id"]] == 1), default=0)
        quota = n * (most / n) ** (1 - t)
        assert got[s] <= quota + 1e-3 and got[s] >= quota - max(1, smallest_out) * 4

    before, after = held["best-fit packing"]
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in before:
        ids = [*own.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[r["doc_id"], k, at, len(ids[at : at + 2048]), zlib.crc32(np.asarray(ids[at : at + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want
    places = {}
    for r in after:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(n for _, n in p) <= 2048
    assert len(places) == -(-sum(n for p in places.values() for _, n in p) // 2048)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_packing_and_mixing_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s"), (None, None, None)], "doc_id long, text string, source string")
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 3
    assert mixing.mix(docs).count() == 3
