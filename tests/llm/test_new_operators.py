"""Disclosure, fill-in-middle and periodic runs against brute force, and on awkward tables."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.llm import common, fim, periodic, pii, registry

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, spans string, output string, id string, runs int, row string"


def frame(spark, texts):
    """Texts with repeated rows, null ids and columns of clashing names."""
    rows = [(i, t, None, "s", "o", "i", 7, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, texts[0], None, None, None, None, None, None), (None, None, *[None] * 6)], SCHEMA)


# Personal data


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 6))) for _ in range(n))


def private_texts():
    """An address that a rare name always stands beside, one that a common word does, and copies of one passage."""
    rng = random.Random(3)
    texts = []
    for k in range(500):
        if k % 25 == 0:
            body = f"{sentence(rng, 6)} Quillon {sentence(rng, 3)} the jq.quill@firm.example.com {sentence(rng, 3)} quickset, {sentence(rng, 20)}"
        elif k % 25 == 1:
            body = f"{sentence(rng, 30)} the office +1 (555) 010-{k:04} {sentence(rng, 3)} quietly"
        elif k % 25 == 2:
            body = "Copied Zebulon words zeb@copy.example.com stand here again and again."
        else:
            body = sentence(rng, 40) + " the quiet one qui"
        texts.append(body)
    texts += [None, "", " \n", "4111 1111 1111 1111 and 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "a@b @c.d@e.f x@y..z é@é.é a@b.c@d.e", "+1+12 (555) 010-9999-( +1234567890123456", "9" * 3000, "1 " * 2000, "a@" * 2000 + "b.c", "QUILLON once more"]
    return texts


def test_disclosure_equals_brute_force(spark):
    texts = private_texts()
    docs = frame(spark, texts)
    got = pii.find(docs, carry=("doc_id", "text", "id"))
    assert got.columns == ["doc_id", "text", "id", "spans"]
    want = pii.brute([*texts, texts[0], texts[0], None])
    rows = got.collect()
    assert len(rows) == len(want)
    by_text = dict(zip([*texts, texts[0], texts[0], None], want, strict=True))
    for r in rows:
        assert [(s.kind, s.start, s.end, s.action) for s in r.spans] == by_text[r.text]
    actions = {r.text[s.start : s.end].lower(): s.action for r in rows for s in r.spans if s.kind == "term"}
    assert actions["quillon"] == "generalise" and "zebulon" not in actions and "the" not in actions
    shown = {r.doc_id: r.sanitised for r in pii.sanitise(got).collect()}
    assert "[EMAIL]" in shown[0] and "Qui…" in shown[0] and "quillon" not in shown[0].lower() and shown[500] == ""
    assert pii.find(docs).columns == [c for c in docs.columns if c != "spans"] + ["spans"]


def test_patterns_equal_the_contract(spark):
    """Random strings of the signs that matter: all kinds, without the method's terms."""
    rng = random.Random(8)
    parts = ["1", "22", "255", "256", ".", ".", "@", "a", "b-", "%", "+", " ", "-", "(", ")", "4111111111111111", "é", "\n", "_", "0"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        want = [(k, a, e) for k, a, e, action in pii.brute([t])[0] if action == "mask"]
        assert [(pii.KINDS[k], a, e) for k, a, e, _ in pii.entities(t)] == want, t


def test_disclosure_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], pii.brute([r.text for r in docs]), strict=True))
    rows = registry.QUERIES["op11_disclosure_pii"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        lines = [f"{k}:{a}:{e}" for k, a, e, _ in want[r.doc_id]]
        base = [x for x in lines if not x.startswith("term")]
        assert r.spans == ",".join(lines) and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in pii.KINDS[:4]]
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


# Fill in the middle

ODD = ["", "plain words, and more", "a<P>b", "é日本 x" * 30, "word " * 40000, "1" * 70000 + "z" * 70000, "x", "<", "<S", "a b c <M >"]


def test_boundary_sets():
    rng = np.random.default_rng(4)
    some = np.unique(rng.integers(0, 1 << 19, 3000))
    many = np.unique(rng.integers(1 << 17, 1 << 18, 60000))
    side = np.arange(70000, 200000)
    for values in (some, many, side, np.unique(np.concatenate((some, many, side))), np.array([5])):
        s = fim.BoundarySet(values)
        assert s.select(np.arange(len(values))).tolist() == values.tolist()
    assert {c[0] for v in (some, many, side) for c in fim.BoundarySet(v).containers} == {"array", "bitmap", "run"}


def test_fill_in_middle_equals_brute_force(spark):
    docs = frame(spark, [None, *ODD] * 20)
    out = fim.transform(docs)
    assert out.columns == [c for c in docs.columns if c != "output"] + ["n_units", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == docs.count() and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == fim.brute(r.doc_id, r.text)
        assert r.back == (r.text or "") and (r.id == "i" or r.doc_id is None)
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fill_in_middle_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = registry.QUERIES["op12_fill_in_middle"](spark, SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(fim.ORACLE).fetchall()))


# Periodic runs


def words_with_runs(rng):
    """Words of few or many kinds, repeated groups, groups of groups, and progressions that meet out of step."""
    kinds = rng.choice([1, 2, 3, 60])
    some = lambda n: [rng.randrange(kinds) for _ in range(n)]
    way = rng.random()
    if way < 0.3:
        return some(rng.randint(0, 300))
    if way < 0.6:
        u = some(rng.randint(1, 120))
        return some(rng.randint(0, 30)) + (u * 20)[: rng.randint(len(u), min(20 * len(u), 500))] + some(rng.randint(0, 30))
    if way < 0.8:
        a, b = some(1), some(2)
        for _ in range(12):
            a, b = b, (b + a if rng.random() < 0.7 else b * 2 + a)[:600]
        return b
    u = some(rng.randint(1, 4))
    return (u * 60)[: rng.randint(1, 120)] + (u * 60)[rng.randint(0, 3) : rng.randint(3, 120)] + (u * 60)[: rng.randint(0, 80)]


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        texts = [words_with_runs(rng) for _ in range(rng.randint(1, 3))]
        values, want, at = [], [], 0
        for d, words in enumerate(texts):
            values += [int(common.mix(np.array([w + 1], np.uint64))[0]) | 1 for w in words] + [2 * d]
            want += [(at + s, n, p) for s, n, p in periodic.brute(words)]
            at += len(words) + 1
        s, e, p = periodic.find_runs(np.array(values, np.uint64), max(map(len, texts)))
        assert list(zip(s.tolist(), (e - s).tolist(), p.tolist(), strict=True)) == sorted(want)


def test_one_word_throughout_takes_linear_work(monkeypatch):
    """A long text of one word, and two long runs that meet out of step: no pairs of all with all."""
    seen = []
    pairs = periodic._pairs
    monkeypatch.setattr(periodic, "_pairs", lambda *a: seen.append(pairs(*a)) or seen[-1])
    one = [3] * 20000
    two = [3, 5] * 5000 + [3] + [3, 5] * 5000
    for words in (one, two):
        seen.clear()
        values = np.array([*words, 0], np.uint64)
        s, e, p = periodic.find_runs(values, len(words))
        assert sum(len(m) for m, _ in seen) < 8 * len(words)
        assert (0, len(one)) in set(zip(s.tolist(), e.tolist(), strict=True)) or len(s) > 4900


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(f"w{x}" for x in words_with_runs(rng)) for _ in range(60)] + ["", None, " \n ", "a\x0bb a b " * 9, "x y\n" * 20]
    docs = frame(spark, texts)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: [repr(x) for x in r]
    got = sorted((tuple(r) for r in registry.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(((r.doc_id, *periodic.brute_row(r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect()), key=key)
    out = periodic.collapse(docs)
    assert out.columns == [c for c in docs.columns if c != "runs"] + ["n_words", "runs", "collapsed"]
    assert periodic.collapse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_periodic_query_on_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.QUERIES["op13_periodic_runs"](spark, SF).collect():
        if len((docs[r.doc_id] or "").split()) < 700:
            assert tuple(r)[1:] == periodic.brute_row(r.doc_id, docs[r.doc_id])
