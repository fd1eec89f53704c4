"""The pipeline's near copies, against all pairs compared by brute force."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from credence.llm import components, nearcopies, simhash, tokens
from credence.llm.queries import vocabulary


def jaccard(one, other):
    sets = []
    for text in (one, other):
        words = text.lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize(("salts", "part", "pivots"), [(64, 512, 32), (1, 1, 1)])
def test_survivors_equal_all_pairs(spark, salts, part, pivots, monkeypatch):
    monkeypatch.setattr(nearcopies, "SALTS", salts)
    monkeypatch.setattr(nearcopies, "PART", part)
    monkeypatch.setattr(nearcopies, "PIVOTS", pivots)
    rng = random.Random(5)
    rows = []
    for _ in range(12):
        text = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(150))
        rows += [text, text.upper()]
        for _ in range(10):
            rows.append(edited(rng, rng.choice(rows[-4:]), rng.randint(1, 6)))
    rng.shuffle(rows)
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and jaccard(rows[a], rows[b]) >= nearcopies.SIMILAR:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in nearcopies.survivors(docs).collect()]
    assert sorted(got) == sorted(set(group))


def test_stage_drops_a_copy_at_nine_tenths(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(400))
    words = text.split()
    for k in (50, 150, 250, 350):
        words[k] = "edit"
    assert 0.8 <= jaccard(text, " ".join(words)) < 0.95
    rows = [(1, text), (2, " ".join(words)), (3, None), (None, text), (4, "!!!"), (5, "???")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "None"]


def test_a_chain_is_one_group_and_families_stay_apart(spark):
    """Neighbours of a chain are near copies and its ends are not; a second family shares words with it."""
    rng = random.Random(9)
    texts, text = [], " ".join(f"w{rng.randint(0, 5000)}" for _ in range(120))
    for _ in range(12):
        texts.append(text)
        text = edited(rng, text, 2)
    half = " ".join(texts[0].split()[:60])
    texts += [f"{half} " + " ".join(f"v{rng.randint(0, 5000)}" for _ in range(60)) for _ in range(3)]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if group[a] != group[b] and jaccard(texts[a], texts[b]) >= nearcopies.SIMILAR:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nearcopies.survivors(docs).collect()) == sorted(set(group))


@pytest.mark.parametrize("survivors", [nearcopies.survivors, simhash.survivors])
def test_equal_ids_of_other_texts_and_repeated_rows(spark, survivors):
    rng = random.Random(10)
    prose = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(80)) for _ in range(3)]
    rows = [(1, prose[0], "a"), (1, prose[1], "b"), (2, prose[1], "c"), (3, prose[2], "d"), (3, prose[2], "d"), (None, prose[2], "e"), (None, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string")
    got = sorted((str(r["doc_id"]), r["text"] or "", r["t"]) for r in survivors(docs).collect())
    assert got == sorted([("1", prose[0], "a"), ("1", prose[1], "b"), ("3", prose[2], "d"), ("None", prose[2], "e"), ("None", "", "f")])
    assert survivors(docs.where("false")).count() == 0


def test_prints_keep_small_pairs_of_the_least_similarity(spark):
    """Sets of four and five shingles, whose fingerprints differ most at 0.8, pass the bounds."""
    rng = np.random.default_rng(3)
    worst_bits = worst_values = 0
    for _ in range(2000):
        grams = np.unique(rng.integers(0, 1 << 64, 5, np.uint64))
        one, other = nearcopies.prints(grams[:4]), nearcopies.prints(grams)
        worst_bits = max(worst_bits, sum(((a ^ b) & nearcopies.MASK).bit_count() for a, b in zip(one, other, strict=True)))
        planes = [np.array(nearcopies.sketch(nearcopies.minima(g))).reshape(nearcopies.DEPTH, 4) for g in (grams[:4], grams)]
        differing = np.bitwise_or.reduce(planes[0] ^ planes[1], axis=0).view(np.uint64)
        worst_values = max(worst_values, sum(int(x).bit_count() for x in differing))
    assert 36 < worst_bits <= nearcopies.RADIUS
    assert 48 < worst_values <= nearcopies.SKETCH


def test_short_near_copies_are_one_group(spark):
    """Eight words against nine: four of five shingles are shared."""
    rng = random.Random(11)
    rows = []
    for k in range(200):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nearcopies.survivors(docs).collect()) == list(range(0, 400, 2))


def test_parities_differ_in_no_more_bits_than_sets_in_shingles(spark):
    rng = np.random.default_rng(4)
    exact = 0
    for _ in range(500):
        grams = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 3000)), np.uint64))
        cut = int(rng.integers(0, len(grams)))
        one, other = grams[cut // 2 :], grams[: len(grams) - cut // 3]
        bits = sum(((a ^ b) & nearcopies.MASK).bit_count() for a, b in zip(nearcopies.parities(one), nearcopies.parities(other), strict=True))
        differing = len(np.setxor1d(one, other))
        assert bits <= differing and (bits - differing) % 2 == 0
        exact += bits == differing
    assert exact > 20


def test_a_lower_similarity_is_refused(spark):
    with pytest.raises(ValueError):
        nearcopies.survivors(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 0.7)


def test_later_rounds_settle_only_what_new_links_join(spark, monkeypatch):
    seen = []

    def recorded(links):
        seen.append(links.count())
        return components.components(links)

    monkeypatch.setattr(nearcopies, "components", recorded)
    grown = spark.createDataFrame([(2, 1), (3, 1), (5, 4), (9, 8)], "node long, low long")
    linked = spark.createDataFrame([(2, 3), (1, 3), (3, 5), (2, 4), (6, 7), (5, 7)], "a long, b long")
    got = {r["node"]: r["low"] for r in nearcopies._joined(grown, linked).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 8}
    # of six links, two lie in one component and two join the same ones
    assert seen == [3]
    same = nearcopies._joined(grown, linked.where("a < 0"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, grown.collect()))


def test_no_encoder_stays_in_a_reused_worker():
    """Spark reuses the workers of the stage that encoded; its remembered pieces stayed there through near_dedup."""
    texts = pa.array(["one two three four five six", ""])
    steps = [
        (nearcopies._signatures, pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), texts], ["doc_id", "t", "text"])),
        (nearcopies._compare(0.8), pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), texts, texts], ["a", "b", "text_a", "text_b"])),
    ]
    for step, batch in steps:
        ids, _ = tokens.encoder(vocabulary()).encode(texts)
        assert tokens._encoders
        assert sum(b.num_rows for b in step(iter([batch]))) > 0
        assert not tokens._encoders
        # a later stage encodes as before
        assert tokens.encoder(vocabulary()).encode(texts)[0].tolist() == ids.tolist()
