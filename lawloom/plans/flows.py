"""Registered queries over whole flows: sections to trees and chunks, questions to records and answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import blank, clean_text, normalize_query, url_slug
from ..operators import answers, asking, chunks, lineage, logical, sections, segments, trees, vectors, versions
from ..streaming import answering
from . import queries as base


def _md5(c):
    return F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")


def section_tree(spark, sf_dir):
    """Every node of the documents' paragraphs, in the order of paths."""
    t = trees.section_tree(base.marked_paragraphs(spark, sf_dir), "doc_id")
    return t.select("doc_id", F.array_join("path", "/").alias("path"), F.col("seq").cast("long").alias("seq"), "node_id", _md5("text"))


def subtree_texts(spark, sf_dir):
    """Of every node its text and that of all nodes below."""
    t = trees.subtree_texts(trees.section_tree(base.marked_paragraphs(spark, sf_dir), "doc_id"), "doc_id")
    return t.select("doc_id", F.array_join("path", "/").alias("path"), _md5("text"))


def section_chunks(spark, sf_dir):
    """Level chunks of sections, or their paragraphs where none has labels."""
    c = trees.level_chunks(base.marked_paragraphs(spark, sf_dir), "doc_id", "section")
    return c.select("doc_id", "chunk_id", F.col("depth").cast("long").alias("depth"), _md5("text"))


def logical_chunks(spark, sf_dir):
    """The chunks that documents' sections are embedded as."""
    c = logical.logical_chunks(base.marked_paragraphs(spark, sf_dir))
    longs = [F.col(k).cast("long").alias(k) for k in ("pos", "total_chunks", "token_count", "overlap_tokens")]
    return c.select("doc_id", "chunk_id", "prev_chunk_id", "next_chunk_id", "path_label", *longs, _md5("text"))


def _escaped(c):
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        c = F.replace(c, F.lit(sign), F.lit(f"&{name};"))
    return c


def _gathered(rows, line):
    """(doc_id, section, body): the lines of one document put together in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("doc_id", "section").agg(F.array_join(lines, "").alias("body"))


def section_pages(spark, sf_dir):
    """Documents published as pages, most with paragraph ids and a heading, and read back."""
    rows = base.marked_paragraphs(spark, sf_dir)
    bare = F.concat(F.lit("<p>"), _escaped(F.col("text")), F.lit("</p>"))
    line = F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit('<div id="'), _escaped(F.col("node_id")), F.lit('">'), bare, F.lit("</div>"))).otherwise(bare)
    heading = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("<h2>§ "), "section", F.lit(" Rules<br></h2>"))).otherwise("")
    html = F.concat(F.lit("<html><nav><p>menu</p></nav><script>'<p id=\"p-1.1\">'</script><h1>Title 34</h1>"), heading, F.lit("<article>"), "body", F.lit("</article><p>footer"))
    found = sections.section_content(_gathered(rows, line).select("doc_id", html.alias("html")), "doc_id", "html")
    return found.select("doc_id", "section", "heading", F.col("n").cast("long").alias("n"), "node_id", _md5("text"))


def section_urls(spark, sf_dir):
    """The same pages by their addresses, four in five of which name a section, with what their records have beside paragraphs."""
    rows = base.marked_paragraphs(spark, sf_dir)
    bare = F.concat(F.lit("<p>"), _escaped(F.col("text")), F.lit("</p>"))
    line = F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("<section id='"), _escaped(F.col("node_id")), F.lit("'>"), bare, F.lit("</section>"))).otherwise(bare)
    heading = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("<h3>§ "), "section", F.lit(" Rules</h3>"))).otherwise("")
    html = F.concat(F.lit("<h1>Title 34</h1>"), heading, F.lit("<div id='p-1.1(z)'>another section</div><article>"), "body", F.lit("</article>"))
    url = F.concat(F.lit("https://www.example.org/title-34/part-"), F.substring_index("section", ".", 1), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("/section-"), "section")).otherwise(""))
    pages = _gathered(rows, line).select("doc_id", html.alias("html"), url.alias("url"))
    found = sections.section_content(pages, "doc_id", "html", "url").join(pages.select("doc_id", "url"), "doc_id")
    found = found.withColumns(sections.section_header(F.col("section"), F.col("heading"), F.col("url")))
    return found.select("doc_id", "section", F.col("n").cast("long").alias("n"), "node_id", _md5("text"), "source_name", "document_title", "section_ref", "part")


def section_xml(spark, sf_dir):
    """Documents published as XML sections and read back, with ids from their labels."""
    # References by name and by number, text that needs none, and elements within elements.
    by_number = F.replace(F.replace(_escaped(F.col("text")), F.lit("e"), F.lit("&#101;")), F.lit("&quot;"), F.lit("&#x22;"))
    plain = F.concat(F.lit("<![CDATA["), F.replace(F.col("text"), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
    kind = F.col("n") % 3
    line = F.concat(F.lit("<P>"), F.when(kind == 0, by_number).when(kind == 1, plain).otherwise(_escaped(F.col("text"))), F.lit("<I></I></P>\n"))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<HEAD>§ "), "section", F.lit(" <E T='03'>A &amp; B</E>.</HEAD>"))).otherwise("")
    xml = F.concat(F.lit("<DIV8 TYPE='SECTION'>"), head, "body", F.lit("</DIV8>"))
    found = sections.section_xml(_gathered(base.labelled_lines(spark, sf_dir), line).select("doc_id", "section", xml.alias("xml")), "doc_id", "section", "xml")
    return found.select("doc_id", "heading", F.col("n").cast("long").alias("n"), "node_id", _md5("text"))


def issue_dates(spark, sf_dir):
    """Orders as rows of titles: the first date of one of them."""
    o = base.table(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(" ")
    return sections.issue_dates(o.select((F.col("o_orderkey") % 50).alias("number"), date.alias("latest_issue_date"), F.col("o_orderkey").alias("pos")), "34")


def bm25_removed(spark, sf_dir):
    """Keyword search in a growing index: documents come in two batches, some of them once more, and every third is removed again."""
    path = f"{lineage.shared_dir(spark)}/keywords-{uuid.uuid4().hex}"
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    segments.add(docs.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 4 > 0, F.col("text")).otherwise("an earlier text")), path, "doc_id", "text")
    segments.add(docs.where("doc_id % 2 > 0 or doc_id % 4 = 0"), path, "doc_id", "text")
    segments.remove(docs.where("doc_id % 3 = 0"), path, "doc_id")
    found = segments.search(base.questions(spark, sf_dir), path, "doc_id", 10)
    return found.select("question_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_bounded(spark, sf_dir):
    """Keyword search in a saved index by the bounds of its blocks of postings."""
    path = f"{lineage.shared_dir(spark)}/keywords-{uuid.uuid4().hex}"
    segments.add(base.table(spark, sf_dir, "documents"), path, "doc_id", "text")
    found = segments.search(base.questions(spark, sf_dir), path, "doc_id", 10, bounded=True)
    return found.select("question_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def knn_scoped(spark, sf_dir):
    """Nearest vectors of the same label from a saved table of vectors; some questions name none, or one that has no vectors."""
    path = f"{lineage.shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    e = base.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))
    vectors.save(e, path, "vec_id", "label")
    named = F.when(F.col("vec_id") % 700 == 0, F.lit("none")).when(F.col("vec_id") % 500 != 0, F.col("label"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), "vector", named.alias("label"))
    found = vectors.nearest_saved(q, path, 10, "vec_id", "label")
    return found.select("question_id", "vec_id", F.round("score", 4).alias("score"), (F.col("branch") == 0).alias("in_scope"), F.col("rank").cast("long").alias("rank"))


def page_slugs(spark, sf_dir):
    return base.table(spark, sf_dir, "pages").select("page_id", url_slug(F.col("url")).alias("slug"))


def document_changes(spark, sf_dir):
    """From the documents to those that have labels, cleaned, and benchmark items under negative ids."""
    old = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = base.table(spark, sf_dir, "labels").select("doc_id").distinct()
    new = old.join(labelled, "doc_id", "left_semi").select("doc_id", clean_text(F.col("text")).alias("text"))
    added = base.table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), "text")
    return versions.changes(old, new.unionByName(added), "doc_id", "text").select("doc_id", "change", "new_hash")


def level_rollup(spark, sf_dir):
    """Chunks, characters and tokens of each part and depth, of each part and of all."""
    c = chunks.level_chunks(chunks.paragraphs(base.table(spark, sf_dir, "documents"))).withColumn("part", (F.lit(600) + F.col("doc_id") % 100).cast("string"))
    found = chunks.rollup(c, "part", "depth", "text")
    return found.select(F.col("section").alias("part"), *[F.col(x).cast("long").alias(x) for x in ("depth", "level", "n", "chars", "tokens", "min_tokens", "max_tokens")])


#: Three days of deliveries.
DAYS = ("2026-01-01", "2026-01-02", "2026-01-03")


def chunk_versions(spark, sf_dir):
    """Documents delivered whole on one day, cleaned and in part on the next, with some withdrawn on the third: every version and how long it held."""
    docs = base.table(spark, sf_dir, "documents").select(F.col("source").alias("namespace"), "doc_id", "text", F.lit(1).alias("seq"))
    day = [F.lit(d).cast("date") for d in DAYS]
    keys, content = ["namespace", "doc_id"], ["text"]
    history = versions.begin_versions(docs, keys, content, day[0])
    history = versions.merge_versions(history, docs, keys, content, day[0], "seq")
    again = docs.where("doc_id % 3 > 0").withColumn("text", clean_text(F.col("text")))
    # Each key twice: the later write stands.
    writes = again.withColumn("text", F.lit("overwritten")).unionByName(again.withColumn("seq", F.lit(2)))
    history = versions.merge_versions(history, writes, keys, content, day[1], "seq", complete=True)
    gone = docs.where("doc_id % 5 = 0").withColumn("deleted", F.lit(True))
    history = versions.merge_versions(history, gone, keys, content, day[2], "seq", deleted="deleted")
    return history.select(*keys, F.md5(blank(F.col("text")).cast("binary")).alias("text_md5"), *[F.col(c).cast("string").alias(c) for c in versions.SPAN])


def _flow(spark, sf_dir):
    """(questions, records, vectors): questions with the vector of their own id, some of them small talk."""
    q = base.asked_questions(spark, sf_dir).withColumn("question", F.when(F.col("question_id") % 16 == 5, "Who are you?").otherwise(F.col("question")))
    own = base.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    r = base.records(spark, sf_dir).withColumns({
        "node_id": F.concat(F.lit("p-"), "part", F.lit("."), F.col("doc_id").cast("string"), F.lit("(a)")),
        "source_name": F.when(F.col("doc_id") % 2 == 0, F.col("namespace")), "source_type": F.lit("regulation"),
        "part": F.when(F.col("doc_id") % 5 > 0, F.col("part")),
    })
    return q.join(own, "question_id", "left"), r, own.select(F.col("question_id").alias("doc_id"), "vector")


def semantic_query(spark, sf_dir):
    """Questions to the records that answer them: intent, both searches in scope, fusion, reranking and the gate."""
    found = asking.semantic_query(*_flow(spark, sf_dir))
    return found.select("question_id", "doc_id", F.round("final", 4).alias("final"), F.col("rank").cast("long").alias("rank"), "part")


def _said(asked):
    """What stands in for a model: one question in four fails, the others get an answer of one of three kinds."""
    kind = F.col("question_id") % 4
    text = F.when(kind == 1, "See [Source 1].").when(kind == 2, "Yes.").when(kind == 3, "As [source 99] says")
    return asked.select("question_id", F.when(blank(F.col("context")) != "", text).alias("answer"))


def request_outcomes(spark, sf_dir):
    """Events as questions to a model that their types share: answered, answered before, or told to wait."""
    n = F.col("event_id")
    e = base.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", (n % 40).alias("question_id"), (n % 11 == 0).alias("forced"), (n % 7 == 0).alias("fails"))
    written = F.when(F.col("question_id") % 2 == 0, F.upper("question")).otherwise(F.concat(F.lit("  "), "question"))
    # Normal forms are taken of the questions, not once more of each event's.
    q = base.questions(spark, sf_dir).select("question_id", normalize_query(written).alias("question"))
    asked = e.join(q, "question_id", "left")
    found = answering.decide(asked, "event_id", "ts", "question", "event_type", "forced", "fails", normal=True)
    return found.select("event_id", "outcome", F.col("retry_after").cast("long").alias("retry_after"), "source")


def answer_questions(spark, sf_dir):
    """Questions to cited answers."""
    questions, records, embedded = _flow(spark, sf_dir)
    found = asking.answer(questions, asking.scoped(asking.semantic_query(questions, records, embedded)), _said)
    return found.select("question_id", "out_of_scope", "by_model", _md5("answer"))


QUERIES = {f.__name__: f for f in (section_tree, subtree_texts, section_chunks, logical_chunks, section_pages, section_urls, section_xml, issue_dates, page_slugs, document_changes, bm25_removed, bm25_bounded, knn_scoped, level_rollup, chunk_versions, semantic_query, request_outcomes, answer_questions)}

#: How deep the labels of paragraphs go in the SQL for whole trees.
DEEPEST = 6
TREE = rf"""{base.MARKED},
nodes AS (SELECT doc_id, n, text, node_id, regexp_extract_all(node_id, '\(([^)]+)\)', 1) AS p FROM marked),
pre AS (SELECT *, unnest(range(len(p) + 1)) AS d FROM nodes),
tree AS (SELECT doc_id, p[1:d] AS path, coalesce(max_by(text, n) FILTER (d = len(p)), '') AS text, coalesce(max_by(node_id, n) FILTER (d = len(p)), '') AS node_id FROM pre GROUP BY doc_id, p[1:d])"""
LEVELS = [f"t{DEEPEST} AS (SELECT doc_id, path, text FROM tree WHERE len(path) = {DEEPEST})"]
for _d in range(DEEPEST - 1, -1, -1):
    LEVELS.append(f"""k{_d} AS (SELECT doc_id, path[1:{_d}] AS path, list(text ORDER BY path[{_d + 1}]) AS kids FROM t{_d + 1} WHERE text <> '' GROUP BY doc_id, path[1:{_d}]),
t{_d} AS (SELECT doc_id, path, CASE WHEN kids IS NULL THEN text ELSE replace(list_reduce(kids, lambda a, c: CASE WHEN contains(lower(replace(a, chr(1), ' ')), lower(c)) THEN a WHEN a = '' THEN c ELSE a || chr(1) || c END, text), chr(1), chr(10)) END AS text
  FROM (SELECT * FROM tree WHERE len(path) = {_d}) LEFT JOIN k{_d} USING (doc_id, path))""")
SUBTREES = ",\n".join([TREE, *LEVELS]) + ",\nwhole AS (" + " UNION ALL ".join(f"SELECT doc_id, path, text FROM t{d}" for d in range(DEEPEST + 1)) + ")"

WORDS = "concat_ws(' ', section_ref, node, coalesce(source_name, ''), part, content)"
SEMANTIC = f"""{base.ASKED}, qs AS (SELECT * FROM asked_q WHERE item_id % 16 <> 5), {base.RECORDS},
recs AS (SELECT doc_id, section_ref, coalesce(content, '') AS content, CASE WHEN doc_id % 2 = 0 THEN namespace END AS source_name, part AS full_part, CASE WHEN doc_id % 5 > 0 THEN part ELSE '' END AS part, 'p-' || part || '.' || doc_id || '(a)' AS node FROM records),
{base.BM25.replace(f"SELECT doc_id, {base.TOKENS.format('text')} AS t FROM documents", f"SELECT doc_id, {base.TOKENS.format(WORDS)} AS t FROM recs").replace("FROM benchmark)", "FROM qs)")},
hints AS (SELECT item_id AS question_id, {base.PART_HINT.format("text")} AS hint, {base.NODE_ASKED.format(r"regexp_replace(text, '\s+', '', 'g')")} AS named FROM qs),
kws AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM kw JOIN recs USING (doc_id) JOIN hints USING (question_id) WHERE score > 0 AND (hint = '' OR full_part = hint)),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, node, part FROM embeddings JOIN recs ON doc_id = vec_id),
s AS (SELECT question_id, e.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], e.v) AS score, CASE WHEN named <> '' AND named = node THEN 0 WHEN hint <> '' AND hint = part THEN 1 ELSE 2 END AS b
  FROM hints JOIN embeddings q ON q.vec_id = question_id, e),
sb AS (SELECT *, min(b) OVER (PARTITION BY question_id) AS branch FROM s),
sems AS (SELECT question_id, doc_id, branch, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sb WHERE branch = 2 OR b = branch),
lists AS (SELECT question_id, doc_id, rank FROM kws WHERE rank <= 40 UNION ALL SELECT question_id, doc_id, rank FROM sems WHERE rank <= CASE branch WHEN 0 THEN 10 ELSE 30 END),
summed AS (SELECT question_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM lists GROUP BY ALL),
fused AS (SELECT *, rrf / max(rrf) OVER (PARTITION BY question_id) AS base FROM summed QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(rrf, 8) DESC, doc_id) <= 40),
{base.RERANKED[base.RERANKED.index("intents AS ("):].replace("FROM asked_q)", "FROM qs)")},
g AS (SELECT question_id, doc_id, final, rank, full_part AS part FROM r WHERE rank <= 10 QUALIFY max(final) OVER (PARTITION BY question_id) >= 0.23)"""

ORACLE_SQL = {
    "knn_scoped": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CAST(label AS VARCHAR) AS label FROM embeddings),
q AS (SELECT vec_id AS question_id, v, CASE WHEN vec_id % 700 = 0 THEN 'none' WHEN vec_id % 500 <> 0 THEN label END AS label FROM e WHERE vec_id % 100 = 0),
f AS (SELECT *, label IS NOT NULL AND label <> '' AND label IN (SELECT label FROM e) AS in_scope FROM q),
r AS (SELECT question_id, vec_id, in_scope, list_cosine_similarity(f.v, e.v) AS score FROM f JOIN e ON NOT in_scope OR f.label = e.label)
SELECT question_id, vec_id, round(score, 4) AS score, coalesce(in_scope, false) AS in_scope, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM r QUALIFY rank <= 10""",
    "level_rollup": f"""WITH {base.LEVELS}, sized AS (SELECT CAST(600 + doc_id % 100 AS VARCHAR) AS part, depth, length(text) AS c, len({base.WORDS.format('text')}) AS t FROM levels)
SELECT part, depth::BIGINT AS depth, GROUPING(part, depth)::BIGINT AS level, count(*) AS n, sum(c)::BIGINT AS chars, sum(t)::BIGINT AS tokens, min(t)::BIGINT AS min_tokens, max(t)::BIGINT AS max_tokens FROM sized GROUP BY ROLLUP (part, depth)""",
    "chunk_versions": f"""WITH d AS (SELECT source AS namespace, doc_id, text, CASE WHEN doc_id % 3 > 0 THEN {base.CLEANED.format("text")} END AS again FROM documents WHERE trim(source) <> '' AND doc_id IS NOT NULL),
one AS (SELECT *, CASE WHEN doc_id % 3 = 0 OR again <> coalesce(text, chr(0)) THEN '{DAYS[1]}' WHEN doc_id % 5 = 0 THEN '{DAYS[2]}' END AS valid_to FROM d),
two AS (SELECT namespace, doc_id, again AS text, '{DAYS[1]}' AS valid_from, CASE WHEN doc_id % 5 = 0 THEN '{DAYS[2]}' END AS valid_to FROM d WHERE doc_id % 3 > 0 AND again <> coalesce(text, chr(0)))
SELECT namespace, doc_id, md5(coalesce(text, '')) AS text_md5, '{DAYS[0]}' AS valid_from, valid_to FROM one
UNION ALL SELECT namespace, doc_id, md5(text), valid_from, valid_to FROM two""",
    "section_tree": f"WITH {TREE} SELECT doc_id, array_to_string(path, '/') AS path, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS seq, node_id, md5(text) AS text_md5 FROM tree",
    "subtree_texts": f"WITH {SUBTREES} SELECT doc_id, array_to_string(path, '/') AS path, md5(text) AS text_md5 FROM whole",
    "section_chunks": f"""WITH {SUBTREES}, named AS (SELECT doc_id, min(section) AS section FROM marked GROUP BY doc_id),
c AS (SELECT doc_id, path, text FROM whole WHERE len(path) > 0 AND text <> ''),
f AS (SELECT * FROM c UNION ALL SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE ['p' || n] END, text FROM nodes WHERE doc_id NOT IN (SELECT doc_id FROM c))
SELECT doc_id, section || ':' || array_to_string(path, '/') AS chunk_id, len(path) AS depth, md5(text) AS text_md5 FROM f JOIN named USING (doc_id)""",
    "section_pages": f"""WITH {base.MARKED} SELECT doc_id, CASE WHEN doc_id % 21 > 0 THEN section ELSE '' END AS section, CASE WHEN doc_id % 3 > 0 THEN '§ ' || section || ' Rules' ELSE '' END AS heading,
  row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, CASE WHEN doc_id % 7 > 0 THEN node_id END AS node_id, md5(text) AS text_md5 FROM marked""",
    "section_urls": f"""WITH {base.MARKED}, u AS (SELECT *, split_part(section, '.', 1) AS part, CASE WHEN doc_id % 5 > 0 THEN section ELSE '' END AS named FROM marked),
extra AS (SELECT doc_id, any_value(section) AS section, any_value(part) AS part FROM u WHERE doc_id % 5 = 0 GROUP BY doc_id),
p AS (SELECT doc_id, section, part, named, n, CASE WHEN doc_id % 7 > 0 THEN node_id END AS node_id, text FROM u WHERE doc_id % 5 > 0 OR doc_id % 7 > 0
  UNION ALL SELECT doc_id, section, part, '', -1, 'p-1.1(z)', 'another section' FROM extra)
SELECT doc_id, named AS section, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, node_id, md5(text) AS text_md5,
  'example.org::' || CASE WHEN named <> '' THEN 'section-' || named ELSE 'part-' || part END AS source_name,
  CASE WHEN doc_id % 3 > 0 THEN '§ ' || section || ' Rules' WHEN named <> '' THEN '34 CFR §' || named ELSE '34 CFR' END AS document_title,
  CASE WHEN named <> '' THEN '§' || named ELSE '' END AS section_ref, part FROM p""",
    "request_outcomes": f"""WITH RECURSIVE q AS (SELECT item_id, trim(regexp_replace(lower(text), '[[:space:]]+', ' ', 'g')) AS q FROM benchmark),
r AS (SELECT event_type AS scope, event_id AS n, epoch_us(ts) AS us, md5(coalesce(q, '')) AS q, event_id % 11 = 0 AS forced, event_id % 7 = 0 AS fails,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events LEFT JOIN q ON item_id = event_id % 40 WHERE ts IS NOT NULL),
s AS (SELECT scope, 0::BIGINT AS i, NULL::BIGINT AS n, NULL::BIGINT AS last, []::STRUCT(q VARCHAR, us BIGINT, n BIGINT)[] AS cache, NULL::VARCHAR AS outcome, NULL::BIGINT AS retry_after, NULL::BIGINT AS source FROM r GROUP BY scope
  UNION ALL
  SELECT scope, i, n, CASE WHEN outcome = 'called' THEN us ELSE last END,
    CASE WHEN outcome = 'called' AND NOT fails THEN list_append(list_filter(live, lambda x: x.q <> q), {{'q': q, 'us': us, 'n': n}}) ELSE live END, outcome,
    CASE WHEN outcome = 'skipped' THEN ({answering.COOLDOWN_SECONDS}000000 - (us - last)) // 1000000 END, CASE outcome WHEN 'called' THEN n WHEN 'hit' THEN hit[1].n END
  FROM (SELECT *, CASE WHEN len(hit) > 0 THEN 'hit' WHEN NOT forced AND us - last < {answering.COOLDOWN_SECONDS}000000 THEN 'skipped' ELSE 'called' END AS outcome
    FROM (SELECT *, list_filter(live, lambda x: x.q = q) AS hit
      FROM (SELECT r.*, s.last, list_filter(s.cache, lambda x: r.us - x.us <= {answering.CACHE_SECONDS}000000) AS live FROM s JOIN r ON r.scope = s.scope AND r.i = s.i + 1))))
SELECT n AS event_id, outcome, retry_after, source FROM s WHERE i > 0""",
    "section_xml": f"WITH {base.MARKED} SELECT doc_id, '§ ' || section || CASE WHEN doc_id % 2 = 0 THEN ' A & B.' ELSE '' END AS heading, n, node_id, md5(text) AS text_md5 FROM marked",
    "issue_dates": "SELECT '34' AS number, min_by(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS issue_date FROM orders WHERE o_orderkey % 50 = 34 AND o_orderkey % 3 > 0",
    "page_slugs": r"""WITH t AS (SELECT page_id, regexp_extract(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/+$', ''), '([^/]*)$', 1) AS tail FROM pages)
SELECT page_id, regexp_replace(CASE WHEN tail = '' THEN 'page' ELSE tail END, '[^a-zA-Z0-9._-]+', '_', 'g') AS slug FROM t""",
    "document_changes": f"""WITH n AS (SELECT doc_id, {base.CLEANED.format("text")} AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT -item_id - 1, coalesce(text, '') FROM benchmark)
SELECT coalesce(d.doc_id, n.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN n.t <> coalesce(d.text, '') THEN 'changed' ELSE 'same' END AS change, sha256(n.t) AS new_hash
FROM documents d FULL JOIN n ON d.doc_id = n.doc_id""",
    "bm25_removed": f"WITH {base.BM25.replace('FROM documents', 'FROM documents WHERE doc_id % 3 > 0')} SELECT question_id, doc_id, round(score, 4) AS score, rank FROM kwr WHERE rank <= 10",
    "bm25_bounded": f"WITH {base.BM25} SELECT question_id, doc_id, round(score, 4) AS score, rank FROM kwr WHERE rank <= 10",
    "semantic_query": f"WITH {SEMANTIC} SELECT question_id, doc_id, round(final, 4) AS final, rank, part FROM g",
    "answer_questions": f"""WITH {SEMANTIC},
fit AS (SELECT g.*, hint <> '' AND part = hint AS fits, max(CASE WHEN hint <> '' AND part = hint THEN 1 ELSE 0 END) OVER (PARTITION BY question_id) AS any_fits FROM g JOIN hints USING (question_id)),
sc AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM fit WHERE fits OR any_fits = 0),
c AS (SELECT question_id, rank, section_ref || ' (' || coalesce(source_url, 'https://example.org/current/title-34/part-' || records.part || '/section-' || substr(section_ref, 2)) || ')' AS citation,
  CASE WHEN length(trim(coalesce(content, ''))) > 280 THEN substr(trim(content), 1, 280) || '...' ELSE trim(coalesce(content, '')) END AS snip FROM sc JOIN records USING (doc_id)),
a AS (SELECT question_id, max(citation) FILTER (rank = 1) AS one, string_agg('- ' || rank || '. ' || citation, chr(10) ORDER BY rank) FILTER (rank <= 3) AS footer,
  string_agg('[' || rank || '] ' || citation || chr(10) || snip, chr(10) ORDER BY rank) FILTER (rank <= 5) AS listed FROM c GROUP BY question_id)
SELECT item_id AS question_id, listed IS NULL AS out_of_scope, listed IS NOT NULL AND item_id % 4 > 0 AS by_model, md5(CASE WHEN listed IS NULL THEN '{answers.UNKNOWN_ANSWER}' ELSE CASE item_id % 4
  WHEN 0 THEN '{answers.RETRIEVAL_HEAD}' || chr(10) || listed WHEN 1 THEN 'See ' || one || '.' WHEN 2 THEN 'Yes.' || chr(10) || chr(10) || 'Citations:' || chr(10) || footer ELSE 'As source says' || chr(10) || chr(10) || 'Citations:' || chr(10) || footer END END) AS answer_md5
FROM asked_q LEFT JOIN a ON item_id = question_id""",
}
