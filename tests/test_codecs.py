"""Codecs and tokenizers as parameters: golden values, overlap by two codecs, search by another tokenizer."""

import importlib.util
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lawloom.functions.codecs import WORDS, vocabulary_codec
from lawloom.operators import bm25, chunks, segments

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = ["", None, "A school (public) must report; see 668.32(a).", "  Na\u00efve caf\u00e9 \u2014 \u65e5\u672c\u8a9e  \n", "one", "   ", "word " * 300]


def test_golden_values(spark):
    df = spark.createDataFrame([("It's 34 CFR 668.32",)], "t string")
    tokens = WORDS.encode(F.col("t"))
    assert list(df.select(tokens, WORDS.decode(tokens), WORDS.count(F.col("t"))).first()) == [["It", "'", "s", "34", "CFR", "668", ".", "32"], "It ' s 34 CFR 668 . 32", 8]
    codec = vocabulary_codec(spark, VOCABULARY)
    ids = codec.encode(F.col("t"))
    assert list(df.select(ids, codec.decode(ids), codec.count(F.col("t"))).first()) == [[1026, 338, 4974, 38233, 718, 3104, 13, 2624], "It's 34 CFR 668.32", 8]


def test_round_trip(spark):
    codec, library = vocabulary_codec(spark, VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").withColumn("ids", codec.encode(F.col("t")))
    for r in rows.withColumn("back", codec.decode(F.col("ids"))).collect():
        assert r.ids == library.encode(r.t or "", add_special_tokens=False).ids and r.back == (r.t or "")
    assert spark.createDataFrame([], "t string").select(codec.count(F.col("t"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5])
@pytest.mark.parametrize("words", [True, False])
def test_overlap(spark, n, words):
    import re

    library = Tokenizer.from_file(VOCABULARY)
    encode = (lambda t: re.findall(r"\w+|[^\w\s]", t)) if words else (lambda t: library.encode(t, add_special_tokens=False).ids)
    decode = " ".join if words else (lambda ids: library.decode(ids, skip_special_tokens=False))
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(TEXTS)], "doc_id int, pos int, text string")
    found = chunks.with_overlap(rows, n, codec=WORDS if words else vocabulary_codec(spark, VOCABULARY)).orderBy("pos").collect()
    for i, r in enumerate(found):
        tail = encode(TEXTS[i - 1] or "")[-n:] if i and n else []
        assert (r.overlap_text, r.overlap_tokens, r.has_overlap) == (decode(tail).strip(), len(tail), bool(decode(tail).strip()))


def test_search_by_another_tokenizer(spark, tmp_path):
    @F.pandas_udf("array<string>")
    def pairs(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(t or "").lower()[i : i + 2] for i in range(len(t or "") - 1)])

    docs = spark.createDataFrame([(1, "Handbook"), (2, "hand"), (3, "zzz"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Hand")], "question_id long, question string")
    plain = lambda found: sorted((r.doc_id, round(r.score, 9), r["rank"]) for r in found.collect())
    want = plain(bm25.search(asked, docs, "doc_id", "text", tokenizer=pairs))
    assert [(d, k) for d, _, k in want] == [(1, 2), (2, 1)]
    bm25.save_index(docs, "doc_id", "text", f"{tmp_path}/one", pairs)
    segments.add(docs, f"{tmp_path}/two", "doc_id", "text", tokenizer=pairs)
    assert plain(bm25.search_index(asked, f"{tmp_path}/one", "doc_id", tokenizer=pairs)) == want
    assert plain(segments.search(asked, f"{tmp_path}/two", "doc_id", tokenizer=pairs)) == want
    # Without it, whole words are terms.
    assert [r.doc_id for r in bm25.search(asked, docs, "doc_id", "text").collect()] == [2]


def test_the_vocabulary_is_a_parameter():
    source = importlib.util.find_spec("lawloom.functions.codecs").origin
    assert "/opt/" not in open(source).read() and os.path.isfile(VOCABULARY)
