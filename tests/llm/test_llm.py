"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lawloom.llm import bpe, common, decontaminate, html_text, language, minhash, mpeg, packed, passages, quality, registry, repeats, suffix_array, url_rules

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, parts string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def awkward():
    """Nulls in any column, empty and long texts, repeated rows, ties, shared passages, clashing column names."""
    rng = random.Random(5)
    base, shared = words(rng, 160), words(rng, 60)
    long = " ".join(words(rng, 40) for _ in range(300))
    near = base.split()
    near[70] = "changed"
    texts = [base, base, " ".join(near), None, "", "   \n\t ", "x", shared, words(rng, 30) + " " + shared, shared + " " + words(rng, 30), long, "a " * 900, "!!! 12", words(rng, 5), "é" * 450]
    rows = [(i, t, "en" if i % 3 else None, None, None, "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[4], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(800):
        t = [rng.randint(0, rng.choice([0, 1, 3])) for _ in range(rng.randint(0, 40))]
        assert suffix_array.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_packing():
    a, b = np.array([5, 0, 2**63], np.uint64), np.array([], np.int64)
    assert [x.tolist() for x in packed.unpack(packed.pack(a, b))] == [[5, 0, 2**63], []]


def check_repeats(docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect())
    rows = docs.select("doc_id", "text").collect()
    assert got == sorted((r.doc_id if r.doc_id is not None else -1, *b) for r, b in zip(rows, repeats.brute([r.text for r in rows]), strict=True))


def test_repeats(spark, odd, empty):
    check_repeats(odd)
    check_repeats(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300"))
    assert repeats.remove_repeats(empty).count() == 0


def test_repeated_blocks_agree_with_counting():
    rng = np.random.default_rng(3)
    core = np.sort(rng.integers(0, 5, 60))
    outer = [sum(int(x) << 9 * k for k, x in enumerate(rng.integers(1, 3, 7))) for _ in range(120)]
    left, right = np.array(outer[:60], np.uint64), np.array(outer[60:], np.uint64)
    mask = rng.integers(0, 256, 60)
    assert repeats.repeated_blocks(core, mask, left, right).tolist() == repeats._counted_blocks(core, mask, left, right).tolist()


def check_passages(docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in passages.remove_passages(docs).collect())
    rows = docs.select("doc_id", "text").collect()
    assert got == sorted((r.doc_id if r.doc_id is not None else -1, *b) for r, b in zip(rows, passages.brute([(r.doc_id, r.text) for r in rows]), strict=True))


def test_passages(spark, odd, empty):
    check_passages(odd)
    check_passages(spark.read.parquet(f"{SF}/documents.parquet"))
    assert passages.remove_passages(empty).count() == 0


def test_near_duplicates(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    for size, percent in ((3, 85), (5, 80)):
        truth = minhash.brute([(r.doc_id, r.text) for r in rows], size, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size=size, percent=percent).collect()} == truth
    found = minhash.near_duplicates(odd, size=3, percent=85).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert by[1].component_id == by[2].component_id == 0 and by[4].component_id == 4 and by[3].n_shingles == 0
    assert minhash.near_duplicates(empty).count() == 0


def test_small_sets_never_lose_a_partner():
    rng = random.Random(2)
    for percent in (80, 85):
        for _ in range(1500):
            n = rng.randint(4, 60)
            u = rng.randint(n, n * 100 // percent)
            both = -(-percent * u // 100)
            if both > n:
                continue
            pool = np.array(rng.sample(range(1 << 62), u), np.uint64) * np.uint64(3)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:both], pool[n:])))
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            keys = [set(minhash.band_keys(int(common.mix(s).sum(dtype=np.uint64)), s, minhash.registers(s), len(s), percent)) for s in (a, b)]
            assert keys[0] & keys[1] or (len(a) == len(b) == both), (percent, len(a), len(b), both)


def test_decontamination(spark, odd, empty):
    rng = random.Random(9)
    item = words(rng, 40).split()
    spoiled = item.copy()
    spoiled[7] = spoiled[20] = "other"
    docs = spark.createDataFrame([(1, "before " + " ".join(spoiled) + " after"), (2, words(rng, 80)), (3, " ".join(item[:13]).upper()), (4, " ".join(item[:8])), (5, None), (6, "tiny item")], "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(item)), (11, "tiny item"), (12, None), (None, "x y z"), (13, "!!")], "item_id long, text string")
    found = {r.doc_id: [(o.item_id, o.n_tokens) for o in r.overlaps] for r in decontaminate.find(docs, items).collect()}
    assert found == {1: [(10, 40)], 2: [], 3: [(10, 13)], 4: [], 5: [], 6: [(11, 2)]}
    assert decontaminate.find(odd, items).count() == odd.count()
    assert decontaminate.find(odd, items.limit(0)).where("size(overlaps) > 0").count() == 0
    assert decontaminate.find(empty, items).count() == 0


def test_decontamination_finds_every_planted_passage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    grams = {tuple(w[k : k + 13]) for r in items.collect() for w in [r.text.lower().replace(",", "").replace(".", "").split()] for k in range(len(w) - 12)}
    truth = {r.doc_id for r in docs.collect() for w in [r.text.lower().replace(",", "").replace(".", "").split()] if any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12))}
    got = {r.doc_id for r in decontaminate.find(docs, items).where("size(overlaps) > 0").collect()}
    # What is found beyond whole 13-grams has substitutions or is a whole shorter item.
    more = [r for r in docs.collect() if r.doc_id in got - truth]
    assert truth and truth <= got and all(decontaminate.brute([r.text for r in more], [(r.item_id, r.text) for r in items.collect()]))


def test_quality(spark, odd, empty):
    got = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), held_out=common.remainder(F.col("doc_id"), 4) == 2)
    truth = spark.read.parquet(f"{SF}/labels.parquet")
    right = got.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("x")).first().x
    assert right > 0.95
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 7), (None, 1), (0, 0)], "doc_id long, quality int")
    assert quality.classify(odd, labels).where("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(empty, labels).count() == 0


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = common.remainder(F.col("doc_id"), 5) == 0
    model = language.fit(docs.where(~held), per_language=150)
    right = language.identify(docs.where(held), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x")).first().x
    assert right > 0.98
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert found[3] == found[4] == found[5] == found[12] == ("und", 0.0) and found[0][0] != "und"
    assert language.identify(odd, language.fit(empty)).count() == odd.count()


def test_url_rules(spark):
    urls = ["http://A.example.NET/en/x?y", "https://example.net/EN/x", "http://x.org/fr/", "http://org", "x", None, "http://example.com/de/a#b", "http://badexample.com/de/", "ftp://net", "http://a..net/", "http://x.net?q/en/", "http://h/" + "a/" * 300]
    pages = spark.createDataFrame([(i, u, "v", "w") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string, verdict string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [[i, u] for i, u in enumerate([*urls, urls[0]])])
    truth = sorted(map(repr, con.sql(url_rules.ORACLE).fetchall()))
    got = url_rules.judge(pages, url_rules.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(repr(tuple(r)) for r in got) == truth
    assert url_rules.judge(pages, url_rules.rule_table(spark, ())).where("rule is not null").count() == 0


def test_url_rules_on_pages(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = registry.QUERIES["op6_url_rules"](spark, SF).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, con.sql(url_rules.ORACLE).fetchall()))


def test_bpe_equals_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    extra = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's they'll 'S '' 'd", "\x85  x  \n\n y ", "日本 ١٢ 🙂" * 9, "z" * 5000, "".join(rng.choice("ab' \n1.é") for _ in range(3000))]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    for lexicon in (None, bpe.build_lexicon(docs, path, size=50)):
        rows = bpe.decode(bpe.encode(docs, lexicon, path), path).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
            assert r.decoded == library.decode(r.ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.decode(bpe.encode(empty, bpe.build_lexicon(empty, path), path), path).count() == 0


def test_lexicon_shares_suffixes():
    found = {w.encode(): (i,) for i, w in enumerate(["working", "walking", "talking", "work", "walk"])}
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(found.items()))
    assert all(lexicon.get(w) == ids for w, ids in found.items()) and lexicon.get(b"wor") is None and lexicon.get(b"workings") is None
    assert lexicon.n_states < sum(map(len, found))


def test_mpeg(spark, odd, empty):
    docs = odd.withColumn("payload", F.encode("text", "utf-8"))
    rows = mpeg.add_features(mpeg.add_media(docs)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        b = mpeg.brute(r.text)
        assert hashlib.sha256(r.audio.payload).hexdigest() == b["payload_sha256"] and len(r.audio.payload) == b["payload_bytes"]
        assert r.audio.n_wrong == r.audio.n_skipped == 0 and r.audio.table_ok and r.audio.note == str(b["n_bytes"])
        assert r.audio.n_samples == 1152 * r.audio.n_frames
    assert mpeg.add_features(mpeg.add_media(empty.withColumn("payload", F.lit(b"")))).count() == 0


def test_mpeg_resynchronises():
    good = mpeg.store(b"\xff\xfb\x90\x64" * 288)
    s = mpeg.parse(good)
    broken = b"junk\xff\xfa" + good[s.offsets[0] : s.offsets[1]] + b"noise" + good[s.offsets[1] :] + b"TAG" + bytes(125)
    t = mpeg.parse(broken)
    assert t.skipped == 11 and len(t.offsets) == 2 and t.tags == ["ID3v1"] and t.wrong == 0
    flipped = bytearray(good)
    flipped[s.offsets[1] + 7] ^= 1
    assert mpeg.parse(bytes(flipped)).wrong == 1


def test_html(spark, empty):
    page = """<html><head><title>T</title><style>x</style></head><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><div class="ad banner">Buy, now.</div>
    <article><h1>Head &amp; more</h1><p><b>First  line, with some words.<br><p>Second&nbsp;paragraph, longer, with text. And more.</p><script>var t="</p>";</script>
    <ul><li>One item, too.<li>Two</ul><aside>Side</aside><p>a &lt; b</p><section id="comments"><p>Nice article, really good. Thanks.</p></section></article><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "Head & more\nFirst line, with some words.\nSecond paragraph, longer, with text. And more.\nOne item, too.\nTwo\na < b"
    pages = spark.createDataFrame([(1, page, "t"), (2, None, None), (3, "", "t"), (4, "plain text", "t"), (5, "<p>unclosed <b", "t"), (6, "<script>x", "t"), (1, page, "t")], "page_id long, html string, text string")
    out = html_text.extract(pages).collect()
    assert len(out) == 7 and [r.text for r in out if r.page_id == 2] == [""] and [r.text for r in out if r.page_id == 4] == ["plain text"]
    assert html_text.extract(empty.withColumn("html", F.lit("x"))).count() == 0


def test_html_keeps_the_article_of_every_page(spark):
    import html
    import re

    for r in registry.QUERIES["op8_tag_path_text"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert out and all(r.round_trip for r in out) and len({r.doc_id for r in out}) == len(out)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    truth = minhash.brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert kept == {i for i, (n, c) in truth.items() if i == c}


def test_components_joined(spark):
    """Links in two turns give the components of all of them; new nodes, repeated links and links to itself included."""
    from lawloom.llm.components import components, joined

    links = [(5, 9), (9, 12), (3, 4), (20, 21), (21, 22), (22, 23), (7, 7)]
    more = [(12, 4), (23, 30), (30, 31), (40, 41), (12, 4), (3, 5)]
    found = joined(components(spark.createDataFrame(links, "a long, b long")), spark.createDataFrame(more, "a long, b long"))
    want = {n: 3 for n in (3, 4, 5, 9, 12)} | {n: 20 for n in (20, 21, 22, 23, 30, 31)} | {40: 40, 41: 40}
    assert {r.node: r.comp for r in found.collect()} == want
