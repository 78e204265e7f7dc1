"""Near-duplicates against brute force, components against union-find, sketches against their theory."""

import random

import numpy as np
import pytest

from lumenquarry.llm import components as comp
from lumenquarry.llm import hyperminhash as hmh
from lumenquarry.llm.near_dedup import near_duplicates, without_near_duplicates


def brute(texts, width, threshold=80):
    """Component (smallest index reachable) and set size of each text."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= threshold * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", " \n\t ", "one", "ONE", "one two", "Ä ä", "ä Ä", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("width", "block"), [(2, 512), (5, 3)])
def test_equals_brute_force(spark, monkeypatch, width, block):
    monkeypatch.setattr("lumenquarry.llm.near_dedup.BLOCK", block)
    texts = corpus(width)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts, width)
    got = {r.doc_id: r for r in near_duplicates(docs, width=width).collect()}
    assert len(got) == len(texts)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i][1] == i) for i in got)


def test_keeps_columns_and_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(3, text, "a", 1), (1, text + " end", "b", 2), (3, text, "a", 1), (None, "other words here", None, None), (7, None, "c", 3), (7, "quite different", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, component int")
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id != 3)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_with_rounds(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(220)]
    rng.shuffle(links)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(links, "a long, b long").repartition(8)
    want = {x: find(x) for x in root if any(x in link and link[0] != link[1] for link in links)}
    for local in (30, 10**6):
        got = {r.node: r.component for r in comp.components(frame, local_links=local).collect()}
        assert got == want


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    both = rng.integers(0, 2**63, 4000, np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(4000 * share)
        a = np.unique(both[: n + (4000 - n) // 2])
        b = np.unique(np.concatenate([both[:n], both[n + (4000 - n) // 2 :]]))
        equal = (hmh.registers(a) == hmh.registers(b)).mean()
        assert abs(hmh.estimate(equal, len(a), len(b)) - n / 4000) < 0.2


def test_register_layout():
    low = hmh.registers(np.array([5, 6, 7], np.uint64))
    assert low.dtype == np.uint16 and len(low) == hmh.K
