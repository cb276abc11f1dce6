"""No overlap that the rule allows is missed by the spaced seeds."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from lawloom.llm import decontaminate


@pytest.mark.parametrize("n", range(10, 26))
def test_a_mask_hits_every_allowed_pattern(n):
    """From 26 tokens on, one of the parts of 13 to 20 tokens into which an overlap can be cut is allowed, too."""
    changed = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(1, n - 1), n // 5)])
    hit = np.zeros(len(changed), bool)
    for mask in decontaminate.MASKS:
        bits = int(mask, 2)
        for at in range(n - len(mask) + 1):
            hit |= changed & (bits << at) == 0
    assert hit.all()


def tokens(text):
    return decontaminate.tokens(pa.array([text]))[0]


@pytest.mark.parametrize("n", [10, 12, 13, 15, 16])
def test_whole_items_with_changed_words_are_found(n):
    item = [f"w{k}" for k in range(n)]
    for c in itertools.combinations(range(1, n - 1), n // 5):
        words = ["other" if k in c else w for k, w in enumerate(item)]
        assert decontaminate.overlap(tokens(" ".join(["before", *words, "after"])), tokens(" ".join(item))) == (n, 1, n + 1)


def test_short_items_count_only_whole_beside_longer_ones():
    short, long = tokens("a b c d e f"), tokens(" ".join(f"w{k}" for k in range(20)))
    texts = ["x a b c d e f y", "x a b c d other f y", "w0 w1 w2 w3 w4 w5", " ".join(f"w{k}" for k in range(5, 18))]
    assert [decontaminate.overlap(tokens(t), short) for t in texts] == [(6, 1, 7), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert [decontaminate.overlap(tokens(t), long) for t in texts] == [(0, 0, 0), (0, 0, 0), (0, 0, 0), (13, 0, 13)]


def test_substitutions_as_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "ii", "jj"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 4, 9, 10, 12, 13, 15, 20, 33])))) for k in range(25)]
    items += [(3, items[9][1]), (40, "x y x y x y x y x y x y x y x y")]
    texts = [None, "", "!?", "x y " * 30]
    for _ in range(120):
        w = rng.choice(items)[1].split()
        w = [word() if rng.random() < rng.choice([0, 0.1, 0.25]) else x for x in w[rng.randrange(3) :]]
        texts.append(", ".join([word() for _ in range(rng.randrange(12))] + w + [word() for _ in range(rng.randrange(12))]).upper())
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: [tuple(o) for o in r.overlaps] for r in decontaminate.find(docs, table).collect()}
    want = decontaminate.brute(texts, items)
    assert [got[i] for i in range(len(texts))] == want and sum(map(bool, want)) > 40
