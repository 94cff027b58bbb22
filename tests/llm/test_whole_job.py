"""Training-data operators on rows where a shortened job gave other results."""

import bisect
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hammerline.llm import licenses, mixing, packing
from test_training_operators import held_templates

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_small_and_skewed_sources_meet_their_targets(spark):
    sizes = {"hot": 3000, "tail": 300, "small": 150}
    rows = [(i, "w " * 20, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    planned = mixing.plan([(s, n * 20) for s, n in sizes.items()], max_repeats=1.5)
    got = Counter()
    for r in mixing.mix(docs, max_repeats=1.5).collect():
        got[r.source] += 20
    assert max(e for _, _, e in planned) == pytest.approx(1.5, abs=1e-6)
    whole = sum(n * e for _, n, e in planned)
    for s, n, e in planned:
        assert got[s] / sum(got.values()) == pytest.approx(n * e / whole, rel=0.04)


def test_blocks_stay_within_the_bound():
    for sources in (1, 20, 900, 1000, mixing.MAX_SOURCES):
        for n in (10, 200_000, 10**9):
            assert sources * mixing.blocks_of(n, sources * n, sources) <= 2 * mixing.BLOCKS + sources


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_planned_shares_are_realised(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    totals = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    planned = mixing.plan(list(totals.items()), max_repeats=1.5)
    rows = mixing.mix_ids(docs, max_repeats=1.5)
    got = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    whole, most = sum(n * e for _, n, e in planned), sum(got.values())
    assert rows.select("doc_id").distinct().count() == docs.count()
    assert max(e for _, _, e in planned) > 1.2
    for s, n, e in planned:
        assert got[s] <= 1.5 * n and got[s] / most == pytest.approx(n * e / whole, rel=0.02)


def test_mixing_of_awkward_rows(spark):
    rows = [(None, "a b", "s", "x"), (None, "c", "s", "x"), (1, None, None, "x"), (1, "d e f", None, "x"), (2, "", "empty", "x"), (3, "g " * 5000, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _block string")
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(docs).collect())
    assert set(got) == {r[:3] for r in rows} and max(got.values()) <= 2
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", "_block", "_copy", "_mix_key"]
    assert mixing.mix(docs.limit(0)).count() == 0
    budget = mixing.mix(docs, budget_tokens=100, max_repeats=None)
    assert budget.where("source = 's' and doc_id = 3").count() == 0


def test_joined_and_broadcast_plans_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 50), f"s{i % 7 % 3}") for i in range(500)], "doc_id long, text string, source string")
    few = sorted(map(tuple, mixing.mix_ids(docs).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, mixing.mix_ids(docs).collect())) == few


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:"
GPL = "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or"


def test_wrapped_notices(spark):
    far = "rights\n" + "word\n" * 40 + "reserved"
    texts = {1: MIT, 2: BSD, 3: GPL, 4: "intro " * 30 + "\n" + MIT.replace(" ", "\n"), 5: far, 6: "no notice\nhere", 7: "rights\nreserved", 8: None, 9: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (set(r.labels), r.score) for r in licenses.scan(docs).collect()}
    assert "mit" in got[1][0] and "bsd" in got[2][0] and "gpl-3.0" in got[3][0] and "mit" in got[4][0] and got[7][0] == {"reserved"}
    assert got[1][1] == got[2][1] == 1.0 and all(got[i] == (set(), 0.0) for i in (5, 6, 8, 9))


def test_words_that_only_share_a_line_are_no_notice(spark):
    texts = {1: "you may read the MIT brochure and the driver license rules", 2: "This has 2 0 and mozilla has a public website for license holders", 3: "permission of any person, free of charge: obtaining a copy of associated files is hereby software"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert all(r.labels == [] and r.score == 0.0 for r in licenses.scan(docs).collect())


def test_blocks_by_brute_force(spark):
    rng = random.Random(5)
    notices = [licenses.words_of(t) for _, t in licenses.TEMPLATES]
    texts = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(1, 12)):
            notice = list(rng.choice(notices))
            for _ in range(rng.choice((0, 0, 1, 3))):
                notice.insert(rng.randrange(len(notice) + 1), "x")
            words += notice[: rng.randint(1, len(notice))] if rng.random() < 0.3 else notice
            words += ["y"] * rng.choice((0, 3, 11, 12, 13, 40))
        texts.append((i, "".join(w + rng.choice(" \n,") for w in words), words))
    docs = spark.createDataFrame([t[:2] for t in texts] + [(900, None), (901, ""), (None, "MIT License")], "id long, text string")
    got = {r.id: set(r.labels) for r in licenses.template_matches(docs, "id", "text").groupBy("id").agg(F.collect_set("label").alias("labels")).collect()}
    assert got == {i: labels for i, _, words in texts if (labels := held_templates(words))}


def best_fit_decreasing(lengths, capacity):
    """Number of sequences, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_no_worse_than_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [min(2048, max(1, int(rng.lognormvariate(5.5 + seed / 4, 1.1)))) for _ in range(3000)]
    histogram = Counter(lengths)
    classes = packing.plan_classes(dict(histogram))
    held = Counter()
    for pieces, times in classes:
        assert times > 0 and sum(n * c for n, c in pieces) <= 2048
        for n, c in pieces:
            held[n] += c * times
    assert held == histogram
    assert sum(t for _, t in classes) <= best_fit_decreasing(lengths, 2048)


def test_configured_sequences_hold_several_large_pieces():
    rng = random.Random(8)
    histogram = dict(Counter(rng.randint(100, 1400) for _ in range(4000)))
    made, left = packing.configured(histogram, 2048, 48, 1 / 4)
    several = sum(t for held, t in made if sum(c for n, c in held if n > 512) >= 2)
    assert several > sum(t for _, t in made) / 2
    assert sum(c * t for held, t in made for _, c in held) + sum(left.values()) == 4000


def test_ids_equal_those_of_the_whole_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, encoder = Tokenizer.from_file(path), packing.ChunkEncoder(path)
    odd = ["Don't I'll we've it's", "a  b\t\tc\r\nd", "İstanbul H̱ello ẞ ß ﬁ É", "<|endoftext|> 3.14, foo-bar's", "", None, "日本語 テキスト! 1234 \x00\x01 éÉ", "|||| !!! ''' 'S 's", "ὈΔΥΣΣΕΎΣ ΣΑΣ,", "x" * 300, " ".join(["Word,"] * 9000)]
    for slices in ([odd], [[t] for t in odd]):
        for texts in slices:
            ids, ends = encoder.batch(pa.array(texts, pa.string()))
            for t, a, b in zip(texts, [0, *ends.tolist()], ends.tolist(), strict=False):
                assert ids[a:b].tolist() == own.encode(t or "", add_special_tokens=False).ids
