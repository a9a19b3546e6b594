import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusflow.llm import components, near, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_sets(texts, width):
    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for text in texts:
        words = WORD.findall((text or "").translate(low))
        count = max(1, len(words) - width + 1)
        sets.append({tuple(words[k : k + width]) for k in range(count)} if words else set())
    return sets


def brute(ids, texts, width, percent):
    sets = word_sets(texts, width)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = defaultdict(list)
    for n, own in enumerate(sets):
        common = Counter(m for s in own for m in places[s])
        for m, c in common.items():
            if 100 * c >= percent * (len(own) + len(sets[m]) - c):
                a, b = sorted((root(n), root(m)), key=lambda k: ids[k])
                parent[b] = a
        for s in own:
            places[s].append(n)
    return {ids[n]: (len(sets[n]), ids[root(n)]) for n in range(len(sets))}


def found(df, **options):
    rows = near.near_duplicates(df, **options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.documents(spark, sf_dir).collect()
    wanted = brute([r["doc_id"] for r in rows], [r["text"] for r in rows], 3, 85)
    out = queries.op5_near_duplicates(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == wanted


@pytest.mark.parametrize("width,percent,block", [(3, 85, 400_000), (5, 80, 900)])
def test_copies_of_copies(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rnd = random.Random(4)
    vocabulary = ["w%d" % k for k in range(5000)]
    texts = []
    for _ in range(6):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 120))]
        for _ in range(25):
            if rnd.random() < 0.7:
                words = list(words)
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["A b", "a B", "", None, "a", "solo \t"]
    ids = list(range(100, 100 + len(texts)))
    rnd.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    assert found(df, width=width, percent=percent) == brute(ids, texts, width, percent)


def test_large_family_is_sent_at_most_twice(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 20_000)
    rnd = random.Random(7)
    vocabulary = ["w%d" % k for k in range(5000)]
    base = [rnd.choice(vocabulary) for _ in range(80)]
    texts = []
    for k in range(1200):
        words = list(base)
        words[rnd.randrange(80)] = f"own{k}"
        if k % 40 == 0:  # further away than the threshold from most
            for _ in range(4):
                words[rnd.randrange(80)] = f"far{k}{rnd.random()}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sent = []
    plain = near._sent
    monkeypatch.setattr(near, "_sent", lambda *a: sent.append(plain(*a)) or sent[-1])
    assert found(df) == brute(list(range(1200)), texts, 3, 85)
    counts = sent[0].groupBy("joined", "node").count().collect()
    assert all(r["count"] <= 2 for r in counts if r["joined"])
    assert sum(r["count"] for r in counts) <= 2 * 1200
    tasks = sent[0].groupBy("with_group", "i", "j").count().collect()
    assert max(r["count"] for r in tasks) * 78 <= 2.5 * 20_000


def test_links_inside_a_family_equal_all_pairs():
    rnd = np.random.default_rng(1)
    for percent in (50, 80, 85, 100):
        sets = []
        for _ in range(8):
            base = rnd.choice(400, 40, replace=False)
            for _ in range(6):
                keep = base[rnd.random(len(base)) < rnd.choice([1, 0.95, 0.8])]
                sets.append(np.unique(np.append(keep, rnd.choice(400, 3))).astype(np.uint64))
        pairs = near.linked(sets, percent)
        joined = [k % 5 == 0 for k in range(len(sets))]

        def groups(links):
            label = list(range(len(sets)))
            for a, b in links:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
            return [[label.index(x)] for x in label]

        every = []
        for a in range(len(sets)):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    every.append((a, b))
        assert set(map(tuple, map(sorted, pairs))) <= set(map(tuple, map(sorted, every)))
        assert groups(pairs) == groups(every)
        together = [(0, k) for k in range(len(sets)) if joined[k]]
        some = near.linked(sets, percent, joined)
        assert set(map(tuple, map(sorted, some))) <= set(map(tuple, map(sorted, every)))
        assert groups(together + some) == groups(together + every)


def test_signature_is_circulant_and_estimates_similarity():
    rnd = np.random.default_rng(2)
    values = rnd.integers(0, 1 << 63, 1000).astype(np.uint64)
    a, b = near.signature(values[:900]), near.signature(values[100:])
    assert abs((a == b).mean() - 0.8) < 0.08
    one = near.signature(values[:1])
    circle = near._numbered_places()
    place = int(near._mixed(values[:1] + np.uint64(near.SEED))[0] >> np.uint64(44))
    assert (one == circle[place]).all() and circle[place + 1 if place + 1 < len(circle) else 0][0] == one[1]


def test_bands_miss_rarely():
    for percent in (80, 85, 95):
        rows, bands = near.bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near.MISSED and rows * bands <= near.COORDINATES


def test_components(spark):
    rnd = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(200 + k, 200) for k in range(40)]
    links += [(500, 500), (None, 3)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    out = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert out == {k: 0 for k in range(61)} | {200 + k: 200 for k in range(40)}
    assert components.components(df.limit(0)).collect() == []
