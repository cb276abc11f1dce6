"""Trees, chunks and answers against plain versions, odd pages, saved indexes and the command line."""

import random
import re
import statistics
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_limits import n, plain_merge, plain_pieces

from lawloom.__main__ import main
from lawloom.functions.text import url_slug
from lawloom.operators import asking, bm25, ingest, logical, sections, segments, trees

PARAS = "doc_id long, section string, n long, node_id string, text string"


def plain_texts(paras):
    own = {(): ""}
    for path, text in paras:
        for k in range(len(path)):
            own.setdefault(path[:k], "")
        own[path] = text or own.get(path, "")

    def below(path):
        parts = [own[path]] if own[path] else []
        for child in sorted(p for p in own if p and p[:-1] == path):
            t = below(child)
            if t and t.lower() not in " ".join(parts).lower():
                parts.append(t)
        return "\n".join(parts)

    return {p: below(p) for p in own}


def plain_logical(section, paras, least, most, overlap):
    """(id, text) of each chunk in order."""
    levels = {p: t for p, t in plain_texts([(p, t) for p, _, t in paras]).items() if p and t}
    if not levels:
        levels = {p or (f"p{k}",): t for p, k, t in paras if t}
    scores = {}
    for depth in {len(p) for p in levels}:
        sizes = [n(t) for p, t in levels.items() if len(p) == depth]
        m = statistics.median(sizes)
        scores[depth] = abs(m - 800) + 500 * (m < 200) + 700 * (m > 1500) + 100 * (len(sizes) == 1)
    depth = min(scores, key=lambda d: (scores[d], d), default=0)
    out = []
    for parent in sorted({p[:-1] for p in levels if len(p) == depth}):
        texts = [levels[p] for p in sorted(levels) if len(p) == depth and p[:-1] == parent]
        if sum(map(n, texts)) / len(texts) < least:
            runs = []
            for t in texts:
                if runs and sum(map(n, runs[-1])) < least and sum(map(n, runs[-1])) + n(t) <= most:
                    runs[-1].append(t)
                else:
                    runs.append([t])
            texts = ["\n\n".join(r) for r in runs]
        cut = [piece for t in texts for piece in plain_pieces(t, most)]
        out += [piece for t in plain_merge(cut, least, most) for piece in plain_pieces(t, most)]
    before = ["", *out][: len(out)]
    tails = [" ".join(re.findall(r"\w+|[^\w\s]", b)[-overlap:]) for b in before]
    return [f"{b}\n\n{t}" if b else t for b, t in zip(tails, out, strict=True)]


def random_sections(seed):
    r = random.Random(seed)
    rows, plain = [], {}
    for doc in range(25):
        paras = []
        for k in range(1, r.randint(1, 14)):
            path = tuple(r.choice("abc") if i < 1 else r.choice("12") for i in range(r.randint(0, 3) if doc % 5 else 0))
            text = " ".join(r.choice(("Apple", "bear. x", "cat", "dog;", "eel")) for _ in range(r.choice((0, 1, 2, 5, 9, 30))))
            paras.append((path, k, text))
            rows.append((doc, f"1.{doc}", k, f"p-1.{doc}" + "".join(f"({x})" for x in path) if path or k % 2 else None, text))
        plain[doc] = paras
    return rows, plain


def test_trees_and_logical_chunks(spark):
    rows, plain = random_sections(3)
    df = spark.createDataFrame(rows, PARAS)
    tree = trees.section_tree(df, "doc_id")
    found = {(x.doc_id, tuple(x.path)): x.text for x in trees.subtree_texts(tree, "doc_id").collect()}
    wanted = {(d, p): t for d, paras in plain.items() if paras for p, t in plain_texts([(p, t) for p, _, t in paras]).items()}
    assert found == wanted
    placed = logical.logical_chunks(df, 6, 12, 3).collect()
    for d, paras in plain.items():
        mine = sorted((x.pos, x.text) for x in placed if x.doc_id == d)
        assert [t for _, t in mine] == plain_logical(f"1.{d}", paras, 6, 12, 3), d
    assert len({(x.doc_id, x.chunk_id) for x in placed}) == len(placed)
    links = {(x.doc_id, x.chunk_id): x for x in placed}
    assert all(x.next_chunk_id is None or links[x.doc_id, x.next_chunk_id].prev_chunk_id == x.chunk_id for x in placed)


def test_tree_order_ancestors_and_empty(spark):
    rows = [(1, "1.2", 1, "p-1.2(b)(1)", "deep"), (1, "1.2", 2, "p-1.2(a)", "old"), (1, "1.2", 3, "p-1.2(a)", "new"), (1, "1.2", 4, "p-1.2(a)", " "), (1, "1.2", 5, None, None)]
    tree = {tuple(x.path): (x.seq, x.text) for x in trees.section_tree(spark.createDataFrame(rows, PARAS), "doc_id").collect()}
    assert tree == {(): (0, ""), ("a",): (1, "new"), ("b",): (2, ""), ("b", "1"): (3, "deep")}
    none = spark.createDataFrame([], PARAS)
    assert logical.logical_chunks(none).count() == 0 and trees.subtree_texts(trees.section_tree(none, "doc_id"), "doc_id").count() == 0


def test_pages(spark):
    pages = [
        (1, "<h1>Title</h1><h4>§ 600.2 &amp; more</h4><div id='p-600.2(a)'>One <em>two</em><div id=\"p-600.2(a)(1)\">three<br>four</div></div><p id=p-600.3(a)>other"),
        (2, "<p id='p-1.2'>x<p id='p-1.3(a)'>y<p id='p-1.3(b)'>z<script>no</script><nav>no</nav>"),
        (3, "<p>out</p><article><p>a<p>b <b>c</b><p>ECFR CONTENT d</article>"),
        (4, "<p>only<div>no p</div><p> </p><p id='p-x'>bad id"),
        (5, None), (6, ""), (7, "<h2>§ 5.1</h2>"), (8, "<h2>§ 5.1</h2><p id='p-5.2(a)'>elsewhere</p>"),
    ]
    found = sections.section_content(spark.createDataFrame(pages, "k int, html string"), "k", "html").collect()
    assert sorted((x.k, x.section, x.heading, x.n, x.node_id, x.text) for x in found) == [
        (1, "600.2", "§ 600.2 & more", 1, "p-600.2(a)", "One two three four"), (1, "600.2", "§ 600.2 & more", 2, "p-600.2(a)(1)", "three four"),
        (2, "1.3", "", 1, "p-1.3(a)", "y"), (2, "1.3", "", 2, "p-1.3(b)", "z"),
        (3, "", "", 1, None, "a"), (3, "", "", 2, None, "b c"), (4, "", "", 1, None, "only"), (4, "", "", 2, None, "bad id"),
        (8, "5.1", "§ 5.1", 1, None, "elsewhere"),
    ]


def test_xml_and_dates(spark):
    xml = [(1, "1.2", "<DIV8><HEAD>§ 1.2 A <I>b</I></HEAD><P>Lead.</P><P/><P>(a) ( 1 ) x &lt;y&gt; &amp;amp;</P><P> </P><P>tail</P><PG>no</PG></DIV8>"), (2, "1.3", None), (3, "1.4", "<P>x</P>")]
    found = sections.section_xml(spark.createDataFrame(xml, "k int, s string, x string"), "k", "s", "x").collect()
    assert sorted((x.k, x.heading, x.node_id, x.text) for x in found) == [
        (1, "§ 1.2 A b", "p-1.2", "Lead."), (1, "§ 1.2 A b", "p-1.2(a)(1)", "(a) (1) x <y> &amp;"), (1, "§ 1.2 A b", "p-1.2(p5)", "tail"), (3, "§ 1.4", "p-1.4", "x"),
    ]
    titles = spark.createDataFrame([(34, " ", 0), (34, "2026-01-02", 1), (34, "2026-01-03", 2), (35, None, 3)], "number int, latest_issue_date string, pos int")
    assert [tuple(x) for x in sections.issue_dates(titles, "34").collect()] == [("34", "2026-01-02")]
    with pytest.raises(PySparkException):
        sections.issue_dates(titles, "35").collect()


def test_deep_and_broken_pages():
    """A p ends however deep what is open in it is; pages of any markup take time in proportion to their length."""
    content = lambda html: [t for _, t in sections._content(html, None)[2]]
    assert content("<p>a<b><i><u><s><em><strong><small><code><q>x<p>second") == ["a x", "second"]
    assert content("<ul><li id='p-1.1(a)'><p>x<li id='p-1.1(b)'><p title='a > b'>y</ul>") == ["x", "y"]
    big = ("<i>x" * 250_000, "<p" * 500_000, "<!--" * 250_000, "</p " * 250_000, "<p id='p-1.1(a)" * 60_000, "<i>" * 150_000 + "</b>" * 150_000, "<" * 1_000_000, "<script>" * 100_000, "<article>" * 100_000)
    for html in big:
        begun = time.monotonic()
        sections._content(html, None)
        sections._parsed(html)
        assert time.monotonic() - begun < 20


def test_pages_by_address(spark):
    pages = [
        (1, "<h1>No</h1><h2>A § sign</h2><p id='p-600.2(a)'>in</p><p id='p-600.3(a)'>out", "https://www.x.org/part-600/section-600.2"),
        (2, "<p id='p-bad'>kept<p id='p-600.3(a)'>too", "https://x.org/part-600"),
        (3, "<article><p>one</article><article><p>two</article><p>three", None),
    ]
    found = sections.section_content(spark.createDataFrame(pages, "k int, html string, url string"), "k", "html", "url").collect()
    assert sorted((x.k, x.section, x.heading, x.n, x.node_id, x.text) for x in found) == [
        (1, "600.2", "A § sign", 1, "p-600.2(a)", "in"), (2, "", "", 1, "p-bad", "kept"), (2, "", "", 2, "p-600.3(a)", "too"), (3, "", "", 1, None, "one"),
    ]
    rows = spark.createDataFrame([(1, "own", " "), (2, "", "x"), (3, None, None)], "k int, title string, part string")
    side = spark.createDataFrame([(1, "better"), (2, "  ")], "k int, title string")
    filled = sections.with_defaults(rows, {"title": "T", "part": "600"}, side, "k")
    assert sorted(tuple(r) for r in filled.select("k", "title", "part").collect()) == [(1, "better", "600"), (2, "T", "x"), (3, "T", "600")]


def test_xml_of_all_kinds(spark):
    xml = ["<D><P>&#167; 600.4 Caf&#233; &#x41;</P><P>(a) <![CDATA[c < d]]></P><HEAD/></D>", "<D><P>a &nbsp; b <I>c</I>d & e<P>f</D>", "<P>a<!-- x -->b <P>in</P></P>"]
    frame = spark.createDataFrame(list(enumerate(xml)), "k int, x string").withColumn("s", F.lit("1.1"))
    found = sections.section_xml(frame, "k", "s", "x").collect()
    assert sorted((r.k, r.heading, r.n, r.text) for r in found) == [
        (0, "", 1, "§ 600.4 Café A"), (0, "", 2, "(a) c < d"), (1, "§ 1.1", 1, "a b c d & e f"), (1, "§ 1.1", 2, "f"), (2, "§ 1.1", 1, "a b in"), (2, "§ 1.1", 2, "in"),
    ]


def test_search_with_ids_of_text_and_namespaces(spark):
    rows = [("ab12", "the loan rules of this part", "one"), ("cd", "loan loan loan", "two"), ("ef", "other words entirely", None), ("gh", "a loan again, of rules", "one")]
    records = spark.createDataFrame(rows, "doc_id string, content string, namespace string")
    records = records.select("*", *[F.lit(None).cast("string").alias(c) for c in ("node_id", "part", "section_ref", "source_name", "source_url", "source_type", "authority_level")])
    vectors = spark.createDataFrame([("ab12", [1.0, 0.0]), ("cd", [0.0, 1.0]), ("gh", [0.6, 0.8])], "doc_id string, vector array<double>")
    asked = spark.createDataFrame([("q1", "loan rules", [1.0, 0.1])], "question_id string, question string, vector array<double>")
    order = lambda found: [r.doc_id for r in found.orderBy("rank").collect()]
    assert order(asking.semantic_query(asked, records, vectors, namespace=" one ")) == ["ab12", "gh"]
    assert order(asking.semantic_query(asked, records, vectors, namespace="")) == []
    assert set(order(asking.semantic_query(asked, records, vectors))) == {"ab12", "cd", "gh"}


DOCS = [(1, "apple bear cat"), (2, "apple apple dog"), (3, None), (4, "bear"), (5, ""), (6, "cat 668.32 apple")]


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "apple cat"), (2, "668.32 bear bear"), (3, "")], "question_id long, question string")
    bm25.save_index(docs, "doc_id", "text", f"{tmp_path}/i")
    rows = lambda df: sorted((x.question_id, x.doc_id, round(x.score, 9), x.rank) for x in df.collect())
    assert rows(bm25.search_index(asked, f"{tmp_path}/i", "doc_id")) == rows(bm25.search(asked, docs, "doc_id", "text"))
    gone = docs.where("doc_id in (2, 3)")
    left = rows(bm25.search(asked, docs.where("doc_id not in (2, 3)"), "doc_id", "text"))
    assert rows(bm25.search_index(asked, f"{tmp_path}/i", "doc_id", removed=gone)) == left != []


def test_sources_fill_in(spark):
    rows = spark.createDataFrame([(1, "old", "x"), (2, None, "y")], "k int, title string, text string")
    given = spark.createDataFrame([(1, " ", "7"), (2, "new", None)], "k int, title string, part string")
    found = logical.with_sources(rows, given, "k").orderBy("k").collect()
    assert [(x.k, x.title, x.part) for x in found] == [(1, "old", "7"), (2, "new", "")]


def _record(spark, ids):
    r = spark.createDataFrame([(i, f"rules on loans number {i} of part {600 + i}", f"p-{600 + i}.1(a)", f"§{600 + i}.1(a)") for i in ids], "doc_id long, content string, node_id string, section_ref string")
    return r.withColumns({"part": F.lit(None).cast("string"), "source_name": F.lit("s"), "source_type": F.lit("cfr"), "source_url": F.lit(None).cast("string"), "authority_level": F.lit("Regulation ")})


def test_questions_without_vectors_and_empty_tables(spark):
    asked = spark.createDataFrame([(1, "loans in part 603", None), (2, "hello", None), (3, None, None), (4, "zebra", None)], "question_id long, question string, vector array<double>")
    none = spark.createDataFrame([], "doc_id long, vector array<double>")
    found = asking.semantic_query(asked, _record(spark, range(1, 6)), none, 3)
    assert {(x.question_id, x.doc_id, x.part) for x in found.collect()} == {(1, 3, "603")}
    said = {x.question_id: x for x in asking.answer(asked, found).collect()}
    assert len(said) == 4 and [said[k].out_of_scope for k in (1, 2, 3, 4)] == [False, True, True, True]
    assert "§603.1(a)" in said[1].answer
    assert asking.semantic_query(asked, _record(spark, range(1, 6)).where("false"), none).count() == 0
    assert asking.answer(asked.where("false"), found.where("false")).count() == 0


def test_command_line(spark, tmp_path):
    _record(spark, range(1, 6)).write.parquet(f"{tmp_path}/r")
    assert main(["query", "--records", f"{tmp_path}/r", "--top-k", "1", "loans in part 603", "hi"])[0].startswith("1.1 ")
    assert "§603.1(a)" in main(["ask", "--records", f"{tmp_path}/r", "loans in part 603"])[0]
    with pytest.raises(SystemExit):
        main(["ask", "--records", f"{tmp_path}/r", "--top-k", "26", "x"])
    spark.createDataFrame(random_sections(5)[0], PARAS).write.parquet(f"{tmp_path}/p")
    main(["chunk", "--paragraphs", f"{tmp_path}/p", "--out", f"{tmp_path}/o", "--least", "6", "--most", "12", "--overlap", "3"])
    report = "\n".join(x.value for x in spark.read.text(f"{tmp_path}/o/report").collect())
    assert report.count("=== BASE CHUNK ") == spark.read.json(f"{tmp_path}/o/chunks").count() > 0


def test_ingest(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 8)], "doc_id long, vector array<double>")
    more = _record(spark, [9]).withColumns({"doc_id": F.lit(8).cast("long"), "content": F.lit("please complete the CAPTCHA")})
    counts = ingest.ingest(_record(spark, [1, 2, 2, 3]).unionByName(more), vectors, f"{tmp_path}/1").first()
    assert tuple(counts) == (3, 1, 0, 2)
    again = ingest.ingest(_record(spark, [3, 4]).unionByName(more.withColumn("doc_id", F.lit(1).cast("long"))), vectors, f"{tmp_path}/2", previous=f"{tmp_path}/1").first()
    assert tuple(again) == (2, 1, 2, 2)
    records, embedded = ingest.open_index(spark, f"{tmp_path}/2")
    asked = spark.createDataFrame([(1, "loans in part 603", [3.0, 1.0])], "question_id long, question string, vector array<double>")
    assert asking.semantic_query(asked, records, embedded, 2).where("rank = 1").first().doc_id == 3
    assert {x.doc_id for x in segments.search(asked, f"{tmp_path}/2/keywords", "doc_id").collect()} == {1, 2, 3, 4}
    saved = asking.semantic_query(asked, records, embedded, 4, keywords=f"{tmp_path}/2/keywords").select("doc_id", "rank", F.round("final", 5).alias("f"))
    assert sorted(saved.collect()) == sorted(asking.semantic_query(asked, records, embedded, 4).select("doc_id", "rank", F.round("final", 5).alias("f")).collect())
    with pytest.raises(ValueError, match="no vector"):
        ingest.ingest(_record(spark, [99]), vectors, f"{tmp_path}/3")
    with pytest.raises(ValueError, match="dimensions"):
        ingest.ingest(_record(spark, [1, 2]), vectors.where("doc_id <> 2").union(spark.createDataFrame([(2, [1.0])], vectors.schema)), f"{tmp_path}/4")
    with pytest.raises(PySparkException):
        ingest.open_index(spark, f"{tmp_path}/4")


def test_the_last_write_stands_with_its_own_vector(spark, tmp_path):
    twice = _record(spark, [1, 1, 2]).withColumn("seq", F.monotonically_increasing_id())
    rows = [("zzz old", 1, 1), ("aaa new", 1, 2), ("two", 2, 1)]
    writes = spark.createDataFrame(rows, "content string, doc_id long, seq long")
    writes = writes.join(twice.drop("content", "seq").dropDuplicates(["doc_id"]), "doc_id")
    vectors = spark.createDataFrame([(1, 1, [9.0, 9.0]), (1, 2, [0.0, 1.0]), (2, 1, [1.0, 1.0])], "doc_id long, seq long, vector array<double>")
    ingest.ingest(writes, vectors, f"{tmp_path}/1", order="seq")
    records, embedded = ingest.open_index(spark, f"{tmp_path}/1")
    assert {r.doc_id: r.content for r in records.collect()} == {1: "aaa new", 2: "two"}
    assert {r.doc_id: r.vector for r in embedded.collect()} == {1: [0.0, 1.0], 2: [1.0, 1.0]}
    with pytest.raises(ValueError, match="different rows"):
        ingest.ingest(writes.drop("seq"), vectors.where("seq = 1").drop("seq"), f"{tmp_path}/1")
    with pytest.raises(PySparkException):
        ingest.open_index(spark, f"{tmp_path}/1")


def test_growing_index_equals_one_made_anew(spark, tmp_path):
    """Adding, adding again, removing and compacting in turn, against BM25 over what is left."""
    rng = random.Random(4)
    path, live = str(tmp_path / "k"), {}
    asked = spark.createDataFrame([(1, "apple bear apple"), (2, "dog 668.32"), (3, "nothing here"), (4, None)], "question_id long, question string")
    text = lambda: " ".join(rng.choice(("apple", "bear", "cat", "dog", "668.32", "eel")) for _ in range(rng.randint(0, 9)))
    for turn in range(6):
        if turn in (2, 4):
            gone = rng.sample(sorted(live), 3)
            segments.remove(spark.createDataFrame([(k,) for k in [*gone, "unknown"]], "k string"), path, "k")
            live = {k: t for k, t in live.items() if k not in gone}
        elif turn == 5:
            segments.compact(spark, path, "k")
        else:
            new = {f"k{i}": text() for i in rng.sample(range(20), 9)}
            rows = [*((k, "overwritten apple", 1) for k in new), *((k, t, 2) for k, t in new.items()), (" ", "apple", 1), (None, "apple", 1)]
            segments.add(spark.createDataFrame(rows, "k string, t string, o int"), path, "k", "t", "o")
            live |= new
        # A segment that was never finished isn't there.
        segments.bm25.postings(spark.createDataFrame([("x", "apple")], "k string, t string"), "k", "t").write.mode("overwrite").parquet(f"{path}/segment-99/postings")
        want = bm25.search(asked, spark.createDataFrame(list(live.items()), "k string, t string"), "k", "t", 5)
        got = segments.search(asked, path, "k", 5)
        shown = lambda f: sorted((r.question_id, r.k, r["rank"], round(r.score, 6)) for r in f.collect())
        assert shown(got) == shown(want) and segments.size(spark, path, "k") == len(live)
    some = spark.createDataFrame([("k1",), ("k3",)], "k string")
    assert {r.k for r in segments.search(asked, path, "k", 5, within=some).collect()} <= {"k1", "k3"}
    opened = segments.search(asked.where("question_id = 2"), path, "k")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in opened or "bucket#" in opened and "IN (" in opened


def test_slugs(spark):
    urls = ["https://a.org/x/y%20z.html?q#f", "https://a.org", "https://a.org/", "https://a.org/a/b;c", None, "/p/q r/", "https://a.org/a//"]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select(url_slug(F.col("u")).alias("s")).collect()
    assert [x.s for x in found] == ["y_20z.html", "page", "page", "b", "page", "q_r", "a"]
