"""The registered queries of the retrieval engine, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intent, text
from ..operators import answers, bm25, chunks, fusion, limits, vectors, versions
from ..streaming import spacing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunk records of the retrieval engine."""
    part = F.lit(600) + F.col("doc_id") % 100
    level = F.element_at(F.array(*[F.lit(x) for x in ("statute", "regulation", "sub_regulatory", "low")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("namespace"), F.col("text").alias("content"), part.cast("string").alias("part"),
        F.concat(F.lit("§"), part.cast("string"), F.lit("."), F.col("doc_id").cast("string")).alias("section_ref"),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("https://example.org/title-34/section-"), part.cast("string"), F.lit("."), F.col("doc_id").cast("string"))).alias("source_url"),
        level.alias("authority_level"),
    )


RECORDS = """records AS (
  SELECT doc_id, source AS namespace, text AS content, CAST(600 + doc_id % 100 AS VARCHAR) AS part,
         '§' || (600 + doc_id % 100) || '.' || doc_id AS section_ref,
         CASE WHEN doc_id % 3 > 0 THEN 'https://example.org/title-34/section-' || (600 + doc_id % 100) || '.' || doc_id END AS source_url,
         ['statute', 'regulation', 'sub_regulatory', 'low'][doc_id % 4 + 1] AS authority_level
  FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text")).cast("binary")).alias("clean_md5"))


def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.word_tokens(F.col("text"))).cast("long").alias("token_count"), F.size(text.search_tokens(F.col("text"))).cast("long").alias("search_tokens"), F.char_length(text.blank(F.col("text"))).cast("long").alias("char_count"))


def record_ids(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("doc_id", text.stable_chunk_id(F.col("section_ref"), F.col("source_url"), F.col("content")).alias("chunk_id"), text.section_ref(F.col("part"), F.array(F.lit("a"), F.lit("p"), F.col("part"))).alias("ref"))


def page_sources(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.source_name(F.col("url")).alias("source_name"), F.md5(text.snippet(F.regexp_replace(F.col("html"), r"(?is)<(script|style|nav)\b.*?</\1\s*>", "")).cast("binary")).alias("snippet_md5"))


def page_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return links.groupBy("page_id", "href").agg(F.min("pos").cast("long").alias("first_pos"))


def whole_paragraphs(spark, sf_dir):
    """The whole text of each paragraph."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.paragraphs(F.col("html"))).alias("pos", "body"))
    return found.where("body <> ''").select("page_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


#: Questions that name things in many ways; each is put before user turns.
CASES = (
    "what is p-668.32(e)(5)(ii)", "34 CFR 668.32 (a)", "34CFR668.32", "part668 rules", "34 CFR Part 668", "FFEL rules", "subpart 123", "see P-668.14(a)(B-1)",
    "How are you?", "thanks", "Hello! Who are you?", "part 6680", "668.32.1", "Direct Loan", "",
)


def conversation_intent(spark, sf_dir):
    """Intent of every user turn, as it is and after one of CASES."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.blank(F.col("text")).alias("text"))
    case = F.element_at(F.array(*[F.lit(x) for x in CASES]), ((F.col("conv_id") * 3 + F.col("turn")) % len(CASES) + 1).cast("int"))
    more = c.withColumn("text", F.when(F.col("turn") % 4 < 2, case).otherwise(F.concat(case, F.lit(" "), F.col("text"))))
    both = c.withColumn("variant", F.lit(0)).unionByName(more.withColumn("variant", F.lit(1)))
    q = F.col("text")
    return both.select("conv_id", "turn", "variant", intent.explicit_node_id(q).alias("node_id"), intent.part_hint(q).alias("part"), intent.citation_ref(q).alias("citation"), intent.is_small_talk(q).alias("small_talk"))


def term_stats(spark, sf_dir):
    s = bm25.term_stats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return s.select("term", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    found = bm25.search(questions(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text", 10)
    best = F.max("score").over(Window.partitionBy("question_id"))
    return found.select("question_id", "doc_id", F.round("score", 4).alias("score"), F.round(F.col("score") / best, 4).alias("normalized"), F.col("rank").cast("long").alias("rank"))


def query_vectors(spark, sf_dir, keep):
    return table(spark, sf_dir, "embeddings").where(keep).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))


def knn_topk(spark, sf_dir):
    all_vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = vectors.nearest(query_vectors(spark, sf_dir, "vec_id % 100 = 0"), all_vectors, 20)
    return found.select("question_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _hybrid(spark, sf_dir):
    """Keyword and vector lists of each question, fused; a question's vector is that of its own id."""
    q = questions(spark, sf_dir)
    keyword = bm25.search(q, table(spark, sf_dir, "documents"), "doc_id", "text", 40)
    own = query_vectors(spark, sf_dir, F.lit(True)).join(q.select("question_id"), "question_id", "left_semi")
    semantic = vectors.nearest(own, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), 30, key="doc_id")
    return fusion.fuse(keyword, semantic, key="doc_id")


def rrf_merge(spark, sf_dir):
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("rrf", 8)), "doc_id")
    return _hybrid(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where("rank <= 40").select("question_id", "doc_id", F.round("base", 5).alias("base"), F.col("rank").cast("long").alias("rank"))


def asked_questions(spark, sf_dir):
    """The questions, three in four with a part, a paragraph or a citation before them."""
    part = (F.lit(600) + F.col("question_id") % 100).cast("string")
    section = F.concat(part, F.lit("."), F.col("question_id").cast("string"))
    before = F.when(F.col("question_id") % 4 == 1, F.concat(F.lit("Part "), part, F.lit(": ")))
    before = before.when(F.col("question_id") % 4 == 2, F.concat(F.lit("What is p-"), section, F.lit("(a)? "))).when(F.col("question_id") % 4 == 3, F.concat(F.lit("34CFR"), section, F.lit(" ")))
    return questions(spark, sf_dir).select("question_id", F.concat(F.coalesce(before, F.lit("")), "question").alias("question"))


def _reranked(spark, sf_dir):
    r = records(spark, sf_dir).withColumns({"node_id": F.concat(F.lit("p-"), "part", F.lit("."), F.col("doc_id").cast("string"), F.lit("(a)")), "part": F.when(F.col("doc_id") % 5 > 0, F.col("part"))})
    return fusion.rerank(_hybrid(spark, sf_dir).join(r, "doc_id").join(asked_questions(spark, sf_dir), "question_id"))


def hybrid_rerank(spark, sf_dir):
    top = fusion.gate(_reranked(spark, sf_dir))
    return top.select("question_id", "doc_id", F.round("final", 4).alias("final"), F.col("rank").cast("long").alias("rank"), "section_ref")


def part_scope(spark, sf_dir):
    """Of the reranked records those of the part that the question names, if there are any."""
    top = _reranked(spark, sf_dir)
    part = text.infer_part(F.col("part"), F.col("section_ref"), F.col("node_id"), F.col("source_url"))
    return fusion.part_scope(top.withColumn("part", part)).select("question_id", "doc_id", F.col("rank").cast("long").alias("rank"), "part")


def bm25_filtered(spark, sf_dir):
    """Keyword search without records of another part than the question's, and with a least score; the statistics are those of all."""
    found = bm25.search(asked_questions(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text", None, min_score=1.0).drop("rank")
    part = records(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("part")).otherwise("").alias("part"))
    hint = asked_questions(spark, sf_dir).select("question_id", intent.part_hint(F.col("question")).alias("hint"))
    kept = found.join(part, "doc_id").join(hint, "question_id").where("hint = '' or part = '' or part = hint")
    return bm25.ranked(kept, "doc_id", 10).select("question_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def knn_cascade(spark, sf_dir):
    """Nearest vectors of the same paragraph, else of the same part, else of all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("p-"), (F.col("vec_id") % 50).cast("string")).alias("node"), F.col("label").cast("string").alias("part"))
    part = F.when(F.col("vec_id") % 300 == 0, F.lit("none")).when(F.col("vec_id") % 500 == 0, F.lit("")).otherwise(F.col("part"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), "vector", F.when(F.col("vec_id") % 200 == 0, F.col("node")).otherwise("gone").alias("node"), part.alias("part"))
    q = q.withColumn("node", F.when(F.col("question_id") % 600 == 0, F.lit("")).otherwise(F.col("node")))
    found = vectors.nearest(q, e, 10, scopes=("node", "part"))
    return found.select("question_id", "vec_id", F.round("score", 4).alias("score"), F.col("branch").cast("long").alias("branch"), F.col("rank").cast("long").alias("rank"))


def part_inference(spark, sf_dir):
    """Parts from whatever a record has; kinds of sources and levels of authority by their fixed names."""
    r = records(spark, sf_dir)
    k = F.col("doc_id") % 4
    only = lambda n, c: F.when(k == n, c)
    node = F.concat(F.lit("p-"), F.col("part"), F.lit("."), F.col("doc_id").cast("string"), F.lit("(a)"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Website", " PDF", "", "html")]), (F.col("doc_id") % 4 + 1).cast("int"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("High ", "medium", "low", "Statute", "other")]), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = text.source_type(kind, F.col("source_url"), ("example.org",))
    inferred = text.infer_part(only(0, F.col("part")), only(1, F.col("section_ref")), only(2, node), only(3, F.col("source_url")))
    return r.select("doc_id", inferred.alias("part"), kind.alias("source_type"), text.authority_level(level, kind).alias("authority"))


def node_id_parse(spark, sf_dir):
    r = records(spark, sf_dir)
    node = F.concat(F.lit("p-"), "part", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("."), F.col("doc_id").cast("string"))).otherwise(""), F.lit("(a)("), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 6 > 0, F.lit(")")).otherwise(""))
    return r.select("doc_id", text.node_section(node).alias("section"), F.array_join(text.node_path(node), "/").alias("path"))


def index_texts(spark, sf_dir):
    """What keyword search and embedders read of each record."""
    r = records(spark, sf_dir).withColumn("heading", F.when(F.col("doc_id") % 3 == 0, F.col("section_ref")))
    read = text.search_text(F.col("section_ref"), F.lit(None), F.col("namespace"), F.col("part"), F.col("content"))
    line = text.embedding_text(F.col("heading"), F.col("authority_level"), F.col("content"))
    return r.select("doc_id", F.md5(read.cast("binary")).alias("search_md5"), F.md5(line.cast("binary")).alias("embedding_md5"))


def blocked_pages(spark, sf_dir):
    """Pages, some with marks of a bot check behind them, by both rules."""
    added = F.element_at(F.array(*[F.lit(x) for x in ("", " Complete the CAPTCHA", " complete the captcha, aggressive automated scraping", " complete the captcha, aggressive automated scraping, student eligibility")]), (F.col("page_id") % 4 + 1).cast("int"))
    html = F.concat(text.blank(F.col("html")), added)
    tolerant = text.is_blocked(html, text.TOLERANT_MARKERS, 2, ("student eligibility",))
    return table(spark, sf_dir, "pages").select("page_id", text.is_blocked(html).alias("strict"), tolerant.alias("tolerant"))


def latest_versions(spark, sf_dir):
    """Events as version rows of sections."""
    e = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 10 > 0, "section").otherwise("part").alias("type"), (F.lit(600) + F.col("user_id") % 3).cast("string").alias("part"),
        F.concat(F.lit(" "), (F.col("user_id") % 20).cast("string")).alias("identifier"), F.col("event_type").alias("name"),
        F.when(F.col("event_id") % 7 == 0, False).when(F.col("event_id") % 5 > 0, True).alias("substantive"), (F.col("event_id") % 11 == 0).alias("removed"), "event_id",
    )
    return versions.latest_versions(e, "event_id")


def section_links(spark, sf_dir):
    """Links of pages to sections of their part; each page has some of its own id behind it."""
    part, n = (F.lit(600) + F.col("page_id") % 5).cast("string"), F.col("page_id").cast("string")
    more = [F.lit("<a href='/current/section-"), part, F.lit("."), n, F.lit("#x'></a><a HREF = \"#"), part, F.lit("."), n, F.lit("\"></a><a href=\"#601.1\"></a><a href=\"/current/section-"), part, F.lit("."), n, F.lit("\"></a><a href=\"/section-600.4/extra\">")]
    pages = table(spark, sf_dir, "pages").select("page_id", part.alias("part"), F.concat(text.blank(F.col("html")), *more).alias("html"))
    return versions.section_links(pages, "page_id", "html", "part", "https://example.org").select("page_id", "part", "url", F.col("pos").cast("long").alias("pos"))


def base_summary(spark, sf_dir):
    lines = _line_chunks(spark, sf_dir).select("doc_id", F.size(text.word_tokens(F.col("text"))).cast("long").alias("token_count"))
    return chunks.base_summary(lines, "doc_id")


def target_section(spark, sf_dir):
    """The most frequent section of a document's lines, which are dealt to sections by their length."""
    lines = _line_chunks(spark, sf_dir).select("doc_id", "pos", F.when(F.char_length("text") > 0, F.concat(F.lit("600."), (F.char_length("text") % 3).cast("string"))).alias("section"))
    return chunks.target_section(lines, "doc_id")


def level_chunks(spark, sf_dir):
    c = chunks.level_chunks(chunks.paragraphs(table(spark, sf_dir, "documents")))
    return c.select("doc_id", "chunk_id", F.col("depth").cast("long").alias("depth"), F.col("n_members").cast("long").alias("n_members"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def best_depth(spark, sf_dir):
    c = chunks.level_chunks(chunks.paragraphs(table(spark, sf_dir, "documents")))
    return chunks.best_depth(chunks.depth_stats(c)).select("doc_id", F.col("depth").cast("long").alias("depth"), F.col("n").cast("long").alias("n"), F.col("median").cast("double").alias("median"), F.round("mean", 4).alias("mean"), F.col("score").cast("double").alias("score"))


def base_chunks(spark, sf_dir):
    """The chunks that each document is cut into: those at its best depth, with labels and parents."""
    c = chunks.base_chunks(chunks.level_chunks(chunks.paragraphs(table(spark, sf_dir, "documents"))))
    return c.select("doc_id", "chunk_id", F.col("depth").cast("long").alias("depth"), "path_label", F.array_join("parent_path", "/").alias("parent"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def labelled_lines(spark, sf_dir):
    """The lines of documents as paragraphs of a section; two in three get labels before their text."""
    rows = chunks.paragraphs(table(spark, sf_dir, "documents")).withColumn("n", F.col("pos") + 1)
    labels = F.when(F.col("n") % 3 == 1, "( a ) ").when(F.col("n") % 3 == 2, F.concat(F.lit("(b) ("), F.col("n").cast("string"), F.lit(") "))).otherwise("")
    section = F.concat((F.lit(600) + F.col("doc_id") % 100).cast("string"), F.lit("."), F.col("doc_id").cast("string"))
    return rows.select("doc_id", section.alias("section"), "n", F.concat(labels, "text").alias("text"))


def marked_paragraphs(spark, sf_dir):
    return chunks.paragraph_ids(labelled_lines(spark, sf_dir), "doc_id", "section", "n", "text")


def paragraph_ids(spark, sf_dir):
    """Ids of paragraphs by the labels before their text, or by their place."""
    return marked_paragraphs(spark, sf_dir).select("doc_id", F.col("n").cast("long").alias("n"), "node_id")


def section_texts(spark, sf_dir):
    """Sections as readable text."""
    rows = marked_paragraphs(spark, sf_dir).withColumn("heading", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("§ "), "section")))
    return chunks.readable(rows, "doc_id", "heading", "n", "text").select("doc_id", F.md5(F.col("body").cast("binary")).alias("body_md5"))


def level_summary(spark, sf_dir):
    """Chunks, characters and tokens by document and depth; averages are cut to whole numbers."""
    c = chunks.level_chunks(chunks.paragraphs(table(spark, sf_dir, "documents")))
    sized = c.select("doc_id", "depth", F.char_length("text").alias("chars"), F.size(text.word_tokens(F.col("text"))).alias("tokens"))
    g = sized.groupBy("doc_id", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    return g.select("doc_id", F.col("depth").cast("long").alias("depth"), "n", "chars", "tokens", F.floor(F.col("chars") / F.col("n")).alias("mean_chars"), F.floor(F.col("tokens") / F.col("n")).alias("mean_tokens"))


def chunk_overlap(spark, sf_dir):
    o = chunks.with_overlap(chunks.paragraphs(table(spark, sf_dir, "documents")))
    return o.select("doc_id", *[F.col(k).cast("long").alias(k) for k in ("pos", "prev_pos", "next_pos", "total_chunks")], F.md5(F.col("overlap_text").cast("binary")).alias("overlap_md5"), "has_overlap")


def upsert_latest(spark, sf_dir):
    """The last event of each user and type stands, and purchases are deleted."""
    order = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(order)).where("k = 1")
    gone = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id").distinct()
    return e.join(gone, "event_id", "left_anti").select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


def manifest_counts(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.groupBy("part").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("namespace").alias("n_namespaces"), F.sum(F.when(text.blank(F.col("content")) == "", 1).otherwise(0)).cast("long").alias("n_rejected"))


def embedding_summary(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.min(F.size("embedding")).cast("long").alias("min_dim"), F.max(F.size("embedding")).cast("long").alias("max_dim"), F.array_join(F.array_sort(F.collect_set(F.size("embedding"))), ",").alias("dims"))


def merge_small_siblings(spark, sf_dir):
    m = chunks.merge_small_siblings(chunks.paragraphs(table(spark, sf_dir, "documents")), 40, 120)
    longs = [F.col(c).cast("long").alias(c) for c in ("n_members", "token_count")]
    return m.select("doc_id", "chunk_id", "path_label", *longs, F.md5(F.col("text").cast("binary")).alias("text_md5"))


def answer_cache_ttl(spark, sf_dir):
    """Events as requests, their type as the question: which would be answered from the cache."""
    found = spacing.spaced(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", spacing.CACHE_SECONDS, strict=True)
    return found.select("event_type", "event_id", (~F.col("opened")).alias("from_cache"), "elapsed_us")


def llm_cooldown(spark, sf_dir):
    """Events as requests, their type as the caller: which wait, and for how many whole seconds."""
    found = spacing.spaced(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", spacing.COOLDOWN_SECONDS, strict=False)
    left = F.floor((F.lit(spacing.COOLDOWN_SECONDS * 1_000_000) - F.col("elapsed_us")) / 1_000_000)
    return found.select("event_type", "event_id", (~F.col("opened")).alias("skipped"), F.when(~F.col("opened"), left).cast("long").alias("retry_after"))


def _line_chunks(spark, sf_dir):
    """The lines of documents as chunks, one label deep under their own document."""
    rows = chunks.paragraphs(table(spark, sf_dir, "documents"))
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.array_join("path", "/"), F.col("pos").cast("string"))
    return rows.select("doc_id", "path", name.alias("chunk_id"), F.lit(0).alias("part"), "text", "pos")


def split_oversized(spark, sf_dir):
    s = limits.split_oversized(_line_chunks(spark, sf_dir), 60)
    return s.select("doc_id", "chunk_id", "part_label", limits.token_count(F.col("text")).cast("long").alias("token_count"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def merge_under_min(spark, sf_dir):
    m = limits.merge_under_min(_line_chunks(spark, sf_dir).withColumn("part", F.col("pos")), 20, 60)
    return m.select("doc_id", "chunk_id", F.col("n_members").cast("long").alias("n_members"), F.col("token_count").cast("long").alias("token_count"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def enforce_limits(spark, sf_dir):
    e = limits.enforce(_line_chunks(spark, sf_dir).drop("pos"), 20, 60)
    return e.select("doc_id", "chunk_id", "part_label", F.col("token_count").cast("long").alias("token_count"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _top(spark, sf_dir, k):
    """The first ``k`` fused records of each question."""
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("rrf", 8)), "doc_id")
    top = _hybrid(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    r = records(spark, sf_dir).withColumns({"source_name": F.when(F.col("doc_id") % 2 == 0, F.col("namespace")), "source_type": F.lit("regulation"), "node_id": F.lit("")})
    return top.join(r, "doc_id")


def citations(spark, sf_dir):
    c = answers.citations(_top(spark, sf_dir, 10))
    return c.select("question_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("base", 5).alias("score"), "label", "citation", F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"))


def context_blocks(spark, sf_dir):
    return answers.contexts(_top(spark, sf_dir, 5)).select("question_id", F.md5(F.col("context").cast("binary")).alias("context_md5"), F.char_length("context").cast("long").alias("n_chars"))


def citation_footers(spark, sf_dir):
    return answers.footers(answers.citations(_top(spark, sf_dir, 5)))


def retrieval_answers(spark, sf_dir):
    """Answers without a model: the first citations with their snippets."""
    found = answers.retrieval_answers(questions(spark, sf_dir), answers.citations(_top(spark, sf_dir, 5)))
    return found.select("question_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


def placeholder_answers(spark, sf_dir):
    """An answer that names sources by number, with the citations in their places."""
    cited = answers.citations(_top(spark, sf_dir, 2)).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "citation"))), lambda x: x["citation"]).alias("cited"))
    answer = F.concat(F.lit("For "), F.col("question_id").cast("string"), F.lit(" see [Source 1], [ SOURCE 2 ][source 9] or [source x]."))
    return cited.select("question_id", answers.fill_placeholders(answer, F.col("cited")).alias("answer"))


def asked_scores(spark, sf_dir):
    """What a reference in the question adds for each of its first records; the question names its own section."""
    top = _top(spark, sf_dir, 10).withColumn("node_id", F.concat(F.lit("p-"), F.col("part"), F.lit("."), (F.col("doc_id") % 3).cast("string"), F.lit("(a)")))
    part = (F.lit(600) + F.col("question_id") % 100).cast("string")
    section = F.concat(part, F.lit("."), (F.col("question_id") % 3).cast("string"))
    q = F.concat(F.lit("Part "), part, F.lit(" asks for "), section, F.lit("(a)"))
    named = F.concat("content", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" see p-"), section, F.lit("(a)"))).otherwise(""))
    ref = F.concat("section_ref", F.when(F.col("doc_id") % 3 == 0, " (Merged 2)").otherwise(""))
    score = fusion.asked_score(q, ref, named, F.col("node_id"), F.col("part"))
    return top.select("question_id", "doc_id", F.round(score, 4).alias("asked"))


QUERIES = {f.__name__: f for f in (clean_text, token_counts, record_ids, page_sources, page_links, whole_paragraphs, conversation_intent, term_stats, bm25_topk, knn_topk, rrf_merge, hybrid_rerank, level_chunks, level_summary, best_depth, chunk_overlap, upsert_latest, manifest_counts, embedding_summary, merge_small_siblings, answer_cache_ttl, llm_cooldown, split_oversized, merge_under_min, enforce_limits, citations, context_blocks, citation_footers, asked_scores, part_scope, bm25_filtered, knn_cascade, part_inference, node_id_parse, index_texts, blocked_pages, latest_versions, section_links, base_summary, target_section, retrieval_answers, placeholder_answers, base_chunks, paragraph_ids, section_texts)}

TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+(?:\.[a-z0-9]+)?')"
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
RANKS = r"list_distinct(regexp_extract_all(lower({0}), '[a-z0-9.]+'))"
BARE = "coalesce(html, '')"
for _pattern, _by in text.MARKUP_STEPS:
    BARE = f"regexp_replace({BARE}, '{_pattern}', '{_by}', 'g')"
BM25 = f"""toks AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents),
stats AS (SELECT count(*) AS n, CASE WHEN avg(len(t)) = 0 THEN 1 ELSE avg(len(t)) END AS avgdl FROM toks),
post AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT item_id AS question_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
kw AS (SELECT question_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / greatest(tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl), 1e-9)) AS score
  FROM asked JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY ALL),
kwr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM kw WHERE score > 0)"""
HYBRID = BM25 + """,
sem AS (SELECT q.vec_id AS question_id, v.vec_id AS doc_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
semr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sem),
both_lists AS (SELECT question_id, doc_id, rank FROM kwr WHERE rank <= 40 UNION ALL SELECT question_id, doc_id, rank FROM semr WHERE rank <= 30),
summed AS (SELECT question_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM both_lists GROUP BY ALL),
fused AS (SELECT *, rrf / max(rrf) OVER (PARTITION BY question_id) AS base FROM summed)"""
PARAGRAPHS = r"""lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents),
paras AS (SELECT doc_id, pos, text, chr(CAST(97 + (pos // 5) % 26 AS INTEGER)) || CASE WHEN pos >= 130 THEN CAST(pos // 130 AS VARCHAR) ELSE '' END AS a, CAST(pos % 5 + 1 AS VARCHAR) AS b FROM lines)"""
LEVELS = PARAGRAPHS + """,
up AS (SELECT doc_id, pos, text, a AS path, 1 AS depth FROM paras WHERE text <> '' UNION ALL SELECT doc_id, pos, text, a || '/' || b, 2 FROM paras WHERE text <> ''),
levels AS (SELECT doc_id, path, depth, count(*) AS n_members, string_agg(text, chr(10) ORDER BY pos) AS text FROM up GROUP BY doc_id, path, depth)"""

SPACED = """RECURSIVE r AS (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
f AS (SELECT event_type, event_id, rn, us, us AS last, true AS opened FROM r WHERE rn = 1
  UNION ALL SELECT r.event_type, r.event_id, r.rn, r.us, CASE WHEN r.us - f.last {0} THEN r.us ELSE f.last END, r.us - f.last {0} FROM f JOIN r ON r.event_type = f.event_type AND r.rn = f.rn + 1)"""

TOP = HYBRID + ", " + RECORDS + """,
top AS (SELECT question_id, doc_id, base, rank, namespace, coalesce(content, '') AS content, part, section_ref, source_url, authority_level, CASE WHEN doc_id % 2 = 0 THEN namespace END AS source_name
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(rrf, 8) DESC, doc_id) AS rank FROM fused) JOIN records USING (doc_id)),
cited AS (SELECT *, coalesce(nullif(trim(source_name), ''), CASE WHEN source_url IS NOT NULL THEN 'example.org' END, 'source') AS label,
  section_ref || ' (' || coalesce(source_url, 'https://example.org/current/title-34/part-' || part || '/section-' || substr(section_ref, 2)) || ')' AS citation FROM top)"""

CLEANED = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}]+', ' ', 'g')), '\(\s*([^)]+?)\s*\)', '(\1)', 'g'), '\s+([,;:.])', '\1', 'g'))"
MARKED = rf"""{PARAGRAPHS},
given AS (SELECT doc_id, pos + 1 AS n, (600 + doc_id % 100) || '.' || doc_id AS section, CASE (pos + 1) % 3 WHEN 1 THEN '( a ) ' WHEN 2 THEN '(b) (' || (pos + 1) || ') ' ELSE '' END || text AS raw FROM paras),
clean AS (SELECT doc_id, n, section, {CLEANED.format("raw")} AS text FROM given),
labelled AS (SELECT *, regexp_replace(regexp_extract(text, '^((?:\([^)]+\)\s*)+)', 1), '\)\s+', ')', 'g') AS labels FROM clean WHERE text <> ''),
marked AS (SELECT doc_id, n, section, text, 'p-' || section || CASE WHEN labels = '' AND n > min(n) FILTER (labels = '') OVER (PARTITION BY doc_id) THEN '(p' || n || ')' ELSE labels END AS node_id FROM labelled)"""

#: The specification's rules for questions, written for DuckDB.
PART_HINT = r"CASE WHEN regexp_extract(lower({0}), '\b(?:34\s*cfr\s*)?part\s*(\d{{3}})\b', 1) <> '' THEN regexp_extract(lower({0}), '\b(?:34\s*cfr\s*)?part\s*(\d{{3}})\b', 1) WHEN contains(lower({0}), 'federal family education loan') OR contains(lower({0}), 'ffel') THEN '682' WHEN contains(lower({0}), 'direct loan') THEN '685' ELSE '' END"
NODE_ASKED = r"CASE WHEN regexp_matches({0}, '(?i)p-\d+(\.\d+)+(\([^)]+\))+') THEN 'p-' || regexp_extract({0}, '(?i)p-(\d+(?:\.\d+)+(?:\([^)]+\))+)', 1) WHEN regexp_matches({0}, '\d+(\.\d+)+(\([^)]+\))+') THEN 'p-' || regexp_extract({0}, '(\d+(?:\.\d+)+(?:\([^)]+\))+)', 1) ELSE '' END"
CITED = r"CASE WHEN regexp_matches(lower({0}), '\b\d+\s*cfr\s*\d+(\.\d+)+\b') THEN regexp_extract(lower({0}), '\b\d+\s*cfr\s*\d+(\.\d+)+\b') ELSE regexp_extract(lower({0}), '\b\d+(\.\d+)+\b') END"
CHAT = r"(?i)\b(what\s+is\s+your\s+name|who\s+are\s+you|your\s+name|hello|hi|hey|how\s+are\s+you|good\s+morning|good\s+evening)\b"
INTENT = rf"""{NODE_ASKED.format(r"regexp_replace(q, '\s+', '', 'g')")} AS node_id, {PART_HINT.format("q")} AS part, {CITED.format("q")} AS citation,
  regexp_replace(q, '\s+', '', 'g') = '' OR (regexp_matches(q, '{CHAT}') AND regexp_replace(regexp_replace(q, '{CHAT}', ' ', 'g'), '[^a-zA-Z0-9]+', '', 'g') = '') AS small_talk"""
ASKED = """asked_q AS (SELECT item_id, CASE item_id % 4 WHEN 1 THEN 'Part ' || (600 + item_id % 100) || ': ' WHEN 2 THEN 'What is p-' || (600 + item_id % 100) || '.' || item_id || '(a)? ' WHEN 3 THEN '34CFR' || (600 + item_id % 100) || '.' || item_id || ' ' ELSE '' END || text AS text FROM benchmark)"""
RERANKED = f"""{HYBRID}, {RECORDS}, {ASKED},
intents AS (SELECT item_id AS question_id, text AS question, {PART_HINT.format("text")} AS hint, lower({NODE_ASKED.format(r"regexp_replace(text, '\s+', '', 'g')")}) AS node_asked, {CITED.format("text")} AS cited FROM asked_q),
j AS (SELECT question_id, doc_id, base, section_ref, coalesce(content, '') AS content, source_url, authority_level, hint, node_asked, cited, part AS full_part, 'p-' || part || '.' || doc_id || '(a)' AS node,
  {RANKS.format('question')} AS asked, {RANKS.format("section_ref || ' ' || coalesce(content, '')")} AS whole, {RANKS.format("section_ref || ' ' || substr(coalesce(content, ''), 1, 500)")} AS early
  FROM fused JOIN records USING (doc_id) JOIN intents USING (question_id)),
f AS (SELECT *, round(0.70::DOUBLE * base + 0.25::DOUBLE * (len(list_intersect(asked, whole))::DOUBLE / greatest(len(asked), 1)) + 0.05::DOUBLE * (len(list_intersect(asked, early))::DOUBLE / greatest(len(asked), 1))
  + (CASE WHEN source_url IS NOT NULL THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END + CASE authority_level WHEN 'statute' THEN 0.06::DOUBLE WHEN 'regulation' THEN 0.05::DOUBLE WHEN 'sub_regulatory' THEN 0.02::DOUBLE ELSE 0.01::DOUBLE END)
  - CASE WHEN length(content) > 2600 THEN least((length(content) - 2600)::DOUBLE / 10000, 0.08::DOUBLE) ELSE 0.0::DOUBLE END
  + CASE WHEN cited = '' THEN 0.0::DOUBLE WHEN contains(lower(content), cited) OR contains(lower(section_ref), cited) THEN 0.07::DOUBLE WHEN contains(replace(lower(content) || lower(section_ref), ' ', ''), replace(cited, ' ', '')) THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN node_asked = '' THEN 0.0::DOUBLE WHEN lower(node) = node_asked THEN 0.35::DOUBLE WHEN contains(lower(content), node_asked) OR contains(lower(section_ref), node_asked) THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN hint = '' THEN 0.0::DOUBLE WHEN full_part = hint THEN 0.22::DOUBLE ELSE -0.08::DOUBLE END, 6) AS final FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final DESC, doc_id) AS rank FROM f)"""

ORACLE_SQL = {
    "clean_text": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', ' ', 'g')), '\(\s*([^)]+?)\s*\)', '(\1)', 'g'), '\s+([,;:.])', '\1', 'g'))) AS clean_md5 FROM documents""",
    "token_counts": f"SELECT doc_id, len({WORDS.format('text')}) AS token_count, len({TOKENS.format('text')}) AS search_tokens, length(coalesce(text, '')) AS char_count FROM documents",
    "record_ids": f"WITH {RECORDS} SELECT doc_id, substr(sha256(section_ref || '|' || coalesce(source_url, '') || '|' || coalesce(content, '')), 1, 32) AS chunk_id, '§' || part || '(a)(' || part || ')' AS ref FROM records",
    "page_sources": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\.', '') AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>', '', 'g') AS bare FROM pages)
SELECT page_id, host || '::' || regexp_extract(path, '([^/]*)$', 1) AS source_name, md5(CASE WHEN length(bare) > 300 THEN substr(bare, 1, 300) || '...' ELSE bare END) AS snippet_md5 FROM p""",
    "page_links": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos FROM pages) SELECT page_id, href, min(pos) AS first_pos FROM l GROUP BY page_id, href""",
    "whole_paragraphs": f"""WITH b AS (SELECT page_id, regexp_extract_all({BARE}, chr(1) || '([^' || chr(1) || chr(2) || ']*)', 1) AS ps FROM pages), l AS (SELECT page_id, unnest(ps) AS raw, generate_subscripts(ps, 1) - 1 AS pos FROM b), t AS (SELECT page_id, pos, trim(regexp_replace(raw, '[\\s\\p{{Z}}]+', ' ', 'g')) AS body FROM l) SELECT page_id, pos, md5(body) AS body_md5 FROM t WHERE body <> ''""",
    "conversation_intent": rf"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id, turn, 0 AS variant, text AS q FROM c UNION ALL
  SELECT conv_id, turn, 1, CASE WHEN turn % 4 < 2 THEN said ELSE said || ' ' || text END FROM (SELECT *, [{", ".join(f"'{x}'" for x in CASES)}][(conv_id * 3 + turn) % {len(CASES)} + 1] AS said FROM c))
SELECT conv_id, turn, variant, {INTENT} FROM q""",
    "term_stats": f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM dfs, stats",
    "bm25_topk": f"WITH {BM25} SELECT question_id, doc_id, round(score, 4) AS score, round(score / max(score) OVER (PARTITION BY question_id), 4) AS normalized, rank FROM kwr WHERE rank <= 10",
    "knn_topk": "WITH s AS (SELECT q.vec_id AS question_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM s) SELECT question_id, vec_id, round(score, 4) AS score, rank FROM r WHERE rank <= 20",
    "rrf_merge": f"WITH {HYBRID}, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(rrf, 8) DESC, doc_id) AS rank FROM fused) SELECT question_id, doc_id, round(base, 5) AS base, rank FROM r WHERE rank <= 40",
    "hybrid_rerank": f"""WITH {RERANKED}, g AS (SELECT *, max(final) OVER (PARTITION BY question_id) AS best FROM r WHERE rank <= 10)
SELECT question_id, doc_id, round(final, 4) AS final, rank, section_ref FROM g WHERE best >= 0.23""",
    "part_scope": f"""WITH {RERANKED}, g AS (SELECT question_id, doc_id, rank, full_part AS part, hint <> '' AND full_part = hint AS fits FROM r WHERE rank <= 10)
SELECT question_id, doc_id, rank, part FROM (SELECT *, bool_or(fits) OVER (PARTITION BY question_id) AS any_fits FROM g) WHERE fits OR NOT any_fits""",
    "bm25_filtered": f"""WITH {ASKED}, {BM25.replace("FROM benchmark)", "FROM asked_q)")}, {RECORDS},
h AS (SELECT item_id AS question_id, {PART_HINT.format("text")} AS hint FROM asked_q),
k AS (SELECT question_id, doc_id, score FROM kw JOIN records USING (doc_id) JOIN h USING (question_id) WHERE score >= 1.0 AND (hint = '' OR doc_id % 5 = 0 OR part = hint)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM k)
SELECT question_id, doc_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10""",
    "knn_cascade": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, 'p-' || (vec_id % 50) AS node, CAST(label AS VARCHAR) AS part FROM embeddings),
q AS (SELECT vec_id AS question_id, v, CASE WHEN vec_id % 600 = 0 THEN '' WHEN vec_id % 200 = 0 THEN node ELSE 'gone' END AS node, CASE WHEN vec_id % 300 = 0 THEN 'none' WHEN vec_id % 500 = 0 THEN '' ELSE part END AS part FROM e WHERE vec_id % 100 = 0),
s AS (SELECT question_id, vec_id, list_cosine_similarity(q.v, e.v) AS score, CASE WHEN q.node <> '' AND q.node = e.node THEN 0 WHEN q.part <> '' AND q.part = e.part THEN 1 ELSE 2 END AS b FROM q, e),
f AS (SELECT *, min(b) OVER (PARTITION BY question_id) AS branch FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM f WHERE branch = 2 OR b = branch)
SELECT question_id, vec_id, round(score, 4) AS score, branch, rank FROM r WHERE rank <= 10""",
    "part_inference": f"""WITH {RECORDS},
k AS (SELECT doc_id, doc_id % 4 AS k, part, source_url, ['website', 'pdf', '', 'html'][doc_id % 4 + 1] AS kind, ['high', 'medium', 'low', 'statute', 'other'][doc_id % 5 + 1] AS level FROM records),
t AS (SELECT *, CASE WHEN kind IN ('website', 'html') AND coalesce(source_url, '') LIKE '%example.org%' THEN 'cfr' WHEN kind = '' THEN 'unknown' ELSE kind END AS source_type FROM k)
SELECT doc_id, CASE WHEN k < 3 OR source_url IS NOT NULL THEN part ELSE '' END AS part, source_type,
  CASE level WHEN 'high' THEN CASE WHEN source_type = 'cfr' THEN 'regulation' ELSE 'statute' END WHEN 'medium' THEN 'regulation' WHEN 'low' THEN 'sub_regulatory' WHEN 'statute' THEN 'statute' ELSE 'unknown' END AS authority FROM t""",
    "node_id_parse": f"""WITH {RECORDS} SELECT doc_id, CASE WHEN doc_id % 5 > 0 AND doc_id % 6 > 0 THEN part || '.' || doc_id END AS section, CASE WHEN doc_id % 5 > 0 AND doc_id % 6 > 0 THEN 'a/' || (doc_id % 7) ELSE '' END AS path FROM records""",
    "index_texts": f"""WITH {RECORDS} SELECT doc_id, md5(trim(concat_ws(' ', section_ref, '', coalesce(namespace, ''), part, coalesce(content, '')), ' ')) AS search_md5,
  md5(concat_ws(chr(10), CASE WHEN doc_id % 3 = 0 THEN 'Heading: ' || section_ref END, 'Path: ' || authority_level, CASE WHEN trim(coalesce(content, ''), ' ') <> '' THEN 'Text: ' || trim(content, ' ') END)) AS embedding_md5 FROM records""",
    "blocked_pages": "SELECT page_id, page_id % 4 > 0 AS strict, page_id % 4 = 2 AS tolerant FROM pages",
    "latest_versions": """WITH v AS (SELECT CAST(600 + user_id % 3 AS VARCHAR) AS part, CAST(user_id % 20 AS VARCHAR) AS identifier, event_type AS name, event_id FROM events WHERE event_id % 10 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0)
SELECT part, identifier, name, event_id FROM (SELECT *, row_number() OVER (PARTITION BY part, identifier ORDER BY event_id DESC) AS k FROM v) WHERE k = 1""",
    "section_links": """WITH l AS (SELECT page_id, CAST(600 + page_id % 5 AS VARCHAR) AS part, len(regexp_extract_all(html, 'href="[^"]*"')) AS n FROM pages)
SELECT page_id, part, 'https://example.org/current/section-' || part || '.' || page_id AS url, n AS pos FROM l UNION ALL
SELECT page_id, part, 'https://example.org/section-' || part || '.' || page_id, n + 1 FROM l UNION ALL SELECT page_id, part, 'https://example.org/section-601.1', n + 2 FROM l WHERE part = '601' AND page_id <> 1""",
    "base_summary": f"WITH {PARAGRAPHS}, t AS (SELECT doc_id, len({WORDS.format('text')}) AS t FROM paras) SELECT doc_id, count(*) AS n, coalesce(min(t) FILTER (t > 0), 0) AS min_tokens, coalesce(max(t) FILTER (t > 0), 0) AS max_tokens, coalesce((sum(t) FILTER (t > 0) // count(*) FILTER (t > 0))::BIGINT, 0) AS mean_tokens FROM t GROUP BY doc_id",
    "target_section": f"WITH {PARAGRAPHS}, s AS (SELECT doc_id, '600.' || (length(text) % 3) AS section, count(*) AS n, min(pos) AS first FROM paras WHERE length(text) > 0 GROUP BY ALL) SELECT doc_id, section, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM s) WHERE k = 1",
    "level_chunks": f"WITH {LEVELS} SELECT doc_id, doc_id || ':' || path AS chunk_id, depth, n_members, md5(text) AS text_md5 FROM levels",
    "best_depth": f"WITH {LEVELS}, sized AS (SELECT doc_id, depth, len({WORDS.format('text')}) AS tokens FROM levels), st AS (SELECT doc_id, depth, count(*) AS n, median(tokens) AS median, avg(tokens) AS mean FROM sized WHERE tokens > 0 GROUP BY doc_id, depth), sc AS (SELECT *, abs(median - 800) + CASE WHEN median < 200 THEN 500 ELSE 0 END + CASE WHEN median > 1500 THEN 700 ELSE 0 END + CASE WHEN n = 1 THEN 100 ELSE 0 END AS score FROM st), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, depth) AS k FROM sc) SELECT doc_id, depth::BIGINT AS depth, n, median::DOUBLE AS median, round(mean, 4) AS mean, score::DOUBLE AS score FROM k WHERE k = 1",
    "base_chunks": f"""WITH {LEVELS}, sized AS (SELECT doc_id, depth, len({WORDS.format('text')}) AS t FROM levels),
st AS (SELECT doc_id, depth, count(*) AS n, median(t) AS m FROM sized WHERE t > 0 GROUP BY doc_id, depth),
best AS (SELECT doc_id, depth AS best FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(m - 800) + CASE WHEN m < 200 THEN 500 ELSE 0 END + CASE WHEN m > 1500 THEN 700 ELSE 0 END + CASE WHEN n = 1 THEN 100 ELSE 0 END, depth) AS k FROM st) WHERE k = 1),
d AS (SELECT doc_id, coalesce(max(best), max(depth)) AS depth FROM sized LEFT JOIN best USING (doc_id) GROUP BY doc_id)
SELECT doc_id, doc_id || ':' || path AS chunk_id, depth::BIGINT AS depth, replace(path, '/', ' > ') AS path_label, CASE WHEN depth = 2 THEN split_part(path, '/', 1) ELSE '' END AS parent, md5(text) AS text_md5 FROM levels JOIN d USING (doc_id, depth)""",
    "paragraph_ids": f"WITH {MARKED} SELECT doc_id, n, node_id FROM marked",
    "section_texts": f"""WITH {MARKED} SELECT doc_id, md5(CASE WHEN doc_id % 3 > 0 THEN '§ ' || section || chr(10) || chr(10) ELSE '' END || string_agg('[' || node_id || ']' || chr(10) || text || chr(10) || chr(10), '' ORDER BY n)) AS body_md5 FROM marked GROUP BY doc_id, section""",
    "level_summary": f"WITH {LEVELS}, sized AS (SELECT doc_id, depth, length(text) AS c, len({WORDS.format('text')}) AS t FROM levels) SELECT doc_id, depth::BIGINT AS depth, count(*) AS n, sum(c)::BIGINT AS chars, sum(t)::BIGINT AS tokens, (sum(c) // count(*))::BIGINT AS mean_chars, (sum(t) // count(*))::BIGINT AS mean_tokens FROM sized GROUP BY doc_id, depth",
    "chunk_overlap": f"WITH {PARAGRAPHS}, t AS (SELECT doc_id, pos, lag(pos) OVER w AS prev_pos, lead(pos) OVER w AS next_pos, count(*) OVER (PARTITION BY doc_id) AS total_chunks, coalesce(lag({WORDS.format('text')}) OVER w, []) AS before FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos, prev_pos, next_pos, total_chunks, md5(coalesce(array_to_string(before[greatest(len(before) - 20, 0) + 1:], ' '), '')) AS overlap_md5, len(before) > 0 AS has_overlap FROM t",
    "upsert_latest": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, round(value, 4) AS value FROM k WHERE k = 1 AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase' AND event_id IS NOT NULL)",
    "manifest_counts": f"WITH {RECORDS} SELECT part, count(*) AS n_records, count(DISTINCT namespace) AS n_namespaces, CAST(sum(CASE WHEN coalesce(content, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_rejected FROM records GROUP BY part",
    "embedding_summary": "SELECT label, count(*) AS count, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, coalesce(array_to_string(list_sort(list(DISTINCT len(embedding)) FILTER (embedding IS NOT NULL)), ','), '') AS dims FROM embeddings GROUP BY label",
    "merge_small_siblings": rf"""WITH RECURSIVE {PARAGRAPHS},
s AS (SELECT doc_id, a, b, pos, text, len({WORDS.format('text')}) AS t FROM paras),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a ORDER BY b, pos) AS rn, avg(t) OVER (PARTITION BY doc_id, a) AS mean FROM s),
f AS (SELECT doc_id, a, rn, t AS held, 1 AS n FROM r WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.a, r.rn, CASE WHEN mean < 40 AND held < 40 AND held + t <= 120 THEN held + t ELSE t END, CASE WHEN mean < 40 AND held < 40 AND held + t <= 120 THEN n ELSE n + 1 END
  FROM f JOIN r ON r.doc_id = f.doc_id AND r.a = f.a AND r.rn = f.rn + 1)
SELECT doc_id, doc_id || ':' || a || '/' || arg_min(b, rn) || ':' || arg_min(pos, rn) || CASE WHEN count(*) > 1 THEN '+' || (count(*) - 1) ELSE '' END AS chunk_id,
  a || ' > ' || arg_min(b, rn) || CASE WHEN count(*) > 1 THEN ' (merged ' || count(*) || ' siblings)' ELSE '' END AS path_label, count(*) AS n_members, CAST(sum(t) AS BIGINT) AS token_count, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rn) FILTER (regexp_matches(text, '\S')), '')) AS text_md5
FROM f JOIN r USING (doc_id, a, rn) GROUP BY doc_id, a, n""",
    "answer_cache_ttl": f"WITH {SPACED.format('> 1800000000')} SELECT event_type, event_id, NOT opened AS from_cache, us - last AS elapsed_us FROM f",
    "llm_cooldown": f"WITH {SPACED.format('>= 45000000')} SELECT event_type, event_id, NOT opened AS skipped, CASE WHEN NOT opened THEN CAST(floor((45000000 - (us - last)) / 1000000) AS BIGINT) END AS retry_after FROM f",
    "split_oversized": rf"""WITH RECURSIVE {PARAGRAPHS},
c AS (SELECT doc_id, pos, doc_id || ':' || a || '/' || b || ':' || pos AS id, text, len({WORDS.format('text')}) AS t FROM paras),
cut AS (SELECT doc_id, pos, string_split(regexp_replace(text, '([.!?;])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)) AS l FROM c WHERE t > 60),
segs AS (SELECT doc_id, pos, i, s, len({WORDS.format('s')}) AS t FROM (SELECT doc_id, pos, unnest(range(len(l))) AS i, regexp_replace(unnest(l), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS s FROM cut) WHERE s <> ''),
words AS (SELECT doc_id, pos, i, unnest(range(len(w))) AS j, unnest(w) AS s FROM (SELECT doc_id, pos, i, regexp_split_to_array(s, '[\s\p{{Z}}]+') AS w FROM segs WHERE t > 60)),
items AS (SELECT doc_id, pos, i, 0 AS j, -1 AS lane, s, t FROM segs WHERE t <= 60 UNION ALL SELECT doc_id, pos, i, j, i, s, len({WORDS.format('s')}) FROM words),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY i, j) AS rn FROM items),
f AS (SELECT doc_id, pos, rn, lane, t AS held, 1 AS n FROM r WHERE rn = 1
  UNION ALL SELECT r.doc_id, r.pos, r.rn, r.lane, CASE WHEN r.lane = f.lane AND held + t <= 60 THEN held + t ELSE t END, CASE WHEN r.lane = f.lane AND held + t <= 60 THEN n ELSE n + 1 END
  FROM f JOIN r ON r.doc_id = f.doc_id AND r.pos = f.pos AND r.rn = f.rn + 1),
p AS (SELECT doc_id, pos, n, string_agg(s, ' ' ORDER BY rn) AS text, max(n) OVER (PARTITION BY doc_id, pos) AS parts FROM f JOIN r USING (doc_id, pos, rn) GROUP BY doc_id, pos, n),
o AS (SELECT c.doc_id, CASE WHEN parts > 1 THEN id || '::part' || n ELSE id END AS chunk_id, CASE WHEN parts > 1 THEN '(part ' || n || '/' || parts || ')' ELSE '' END AS part_label, CASE WHEN parts > 1 THEN p.text ELSE c.text END AS text FROM c LEFT JOIN p USING (doc_id, pos))
SELECT doc_id, chunk_id, part_label, len({WORDS.format('text')}) AS token_count, md5(text) AS text_md5 FROM o""",
    "merge_under_min": rf"""WITH RECURSIVE {PARAGRAPHS},
s AS (SELECT doc_id, a, b, pos, text, len({WORDS.format('text')}) AS t, row_number() OVER (PARTITION BY doc_id, a ORDER BY b, pos) AS rn FROM paras),
f AS (SELECT doc_id, a, rn, t AS held, 1 AS n FROM s WHERE rn = 1
  UNION ALL SELECT s.doc_id, s.a, s.rn, CASE WHEN held < 20 AND held + t <= 60 THEN held + t ELSE t END, CASE WHEN held < 20 AND held + t <= 60 THEN n ELSE n + 1 END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.a = f.a AND s.rn = f.rn + 1),
g AS (SELECT doc_id, a, n, sum(t) AS t, doc_id || ':' || a || '/' || arg_min(b, rn) || ':' || arg_min(pos, rn) || CASE WHEN count(*) > 1 THEN '+' || (count(*) - 1) ELSE '' END AS id FROM f JOIN s USING (doc_id, a, rn) GROUP BY doc_id, a, n),
h AS (SELECT doc_id, a, n, t AS held, 1 AS m, id FROM g WHERE n = 1
  UNION ALL SELECT g.doc_id, g.a, g.n, CASE WHEN t < 20 AND held + t <= 60 THEN held + t ELSE t END, CASE WHEN t < 20 AND held + t <= 60 THEN m ELSE m + 1 END, CASE WHEN t < 20 AND held + t <= 60 THEN h.id || '+1' ELSE g.id END
  FROM h JOIN g ON g.doc_id = h.doc_id AND g.a = h.a AND g.n = h.n + 1),
ids AS (SELECT doc_id, a, m, arg_max(id, n) AS id FROM h GROUP BY doc_id, a, m)
SELECT doc_id, any_value(ids.id) AS chunk_id, count(*) AS n_members, CAST(sum(t) AS BIGINT) AS token_count,
  md5(CASE WHEN count(*) > 1 THEN coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rn) FILTER (regexp_matches(text, '\S')), '') ELSE any_value(text) END) AS text_md5
FROM s JOIN f USING (doc_id, a, rn) JOIN (SELECT doc_id, a, n, m FROM h) USING (doc_id, a, n) JOIN ids USING (doc_id, a, m) GROUP BY doc_id, a, m""",
    "citations": f"WITH {TOP} SELECT question_id, doc_id, rank, round(base, 5) AS score, label, citation, md5(CASE WHEN length(trim(content)) > 300 THEN substr(trim(content), 1, 300) || '...' ELSE trim(content) END) AS snippet_md5 FROM cited WHERE rank <= 10",
    "context_blocks": f"""WITH {TOP}, b AS (SELECT question_id, string_agg(concat_ws(chr(10), '[SOURCE ' || rank || ']', 'Section: ' || section_ref, 'Source Name: ' || coalesce(source_name, ''), 'Source Type: regulation', 'Authority Level: ' || authority_level, 'Source URL: ' || coalesce(source_url, ''), 'Content: ' || content), chr(10) || chr(10) ORDER BY rank) AS context FROM top WHERE rank <= 5 GROUP BY question_id)
SELECT question_id, md5(context) AS context_md5, length(context) AS n_chars FROM b""",
    "citation_footers": f"WITH {TOP} SELECT question_id, string_agg('- ' || rank || '. ' || citation, chr(10) ORDER BY rank) AS footer FROM cited WHERE rank <= 3 GROUP BY question_id",
    "retrieval_answers": f"""WITH {TOP}, a AS (SELECT question_id, string_agg('[' || rank || '] ' || citation || chr(10) || CASE WHEN length(trim(content)) > 280 THEN substr(trim(content), 1, 280) || '...' ELSE trim(content) END, chr(10) ORDER BY rank) AS found FROM cited WHERE rank <= 5 GROUP BY question_id)
SELECT item_id AS question_id, md5(CASE WHEN found IS NULL THEN '{answers.UNKNOWN_ANSWER}' ELSE '{answers.RETRIEVAL_HEAD}' || chr(10) || found END) AS answer_md5 FROM benchmark LEFT JOIN a ON item_id = question_id""",
    "placeholder_answers": f"""WITH {TOP}, c AS (SELECT question_id, max(citation) FILTER (rank = 1) AS one, max(citation) FILTER (rank = 2) AS two FROM cited WHERE rank <= 2 GROUP BY question_id)
SELECT question_id, 'For ' || question_id || ' see ' || one || ', ' || coalesce(two, 'source') || 'source or [source x].' AS answer FROM c""",
    "asked_scores": f"""WITH {TOP},
q AS (SELECT question_id, doc_id, part, CAST(600 + question_id % 100 AS VARCHAR) AS hint, (600 + question_id % 100) || '.' || (question_id % 3) AS cited, 'p-' || part || '.' || (doc_id % 3) || '(a)' AS node,
  lower(section_ref) || CASE WHEN doc_id % 3 = 0 THEN ' (merged 2)' ELSE '' END AS ref, lower(content) AS content FROM top WHERE rank <= 10),
s AS (SELECT *, content || CASE WHEN doc_id % 2 = 0 THEN ' see p-' || cited || '(a)' ELSE '' END AS body FROM q)
SELECT question_id, doc_id, round(CASE WHEN contains(body, cited) OR contains(ref, cited) THEN 0.07::DOUBLE WHEN contains(replace(body || ref, ' ', ''), cited) THEN 0.05::DOUBLE ELSE 0 END
  + CASE WHEN node = 'p-' || cited || '(a)' THEN 0.35::DOUBLE WHEN contains(body, 'p-' || cited || '(a)') OR contains(ref, 'p-' || cited || '(a)') THEN 0.10::DOUBLE ELSE 0 END - CASE WHEN doc_id % 3 = 0 THEN 0.05::DOUBLE ELSE 0 END
  + CASE WHEN part = hint THEN 0.22::DOUBLE ELSE -0.08::DOUBLE END, 4) AS asked FROM s""",
}
