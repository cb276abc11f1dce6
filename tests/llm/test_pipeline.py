"""Each stage of the pipeline against brute force, the library or the model's own scores, and all of it on awkward and empty tables."""

import random

import corpus_pipeline as pipeline
import pytest

from lawloom.llm import bpe, decontaminate, language, minhash, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Two languages, near copies, a passage that several share, a test item with a substitution, nulls, empty and repeated texts."""
    rng = random.Random(2)
    passage, item = words(rng, 60), words(rng, 30)
    texts = [words(rng, 70) for _ in range(12)]
    near = texts[0].split()
    near[33] = "other"
    spoiled = item.split()
    spoiled[9] = "other"
    texts += [" ".join(near), texts[1], passage + " " + words(rng, 30), words(rng, 40) + " " + passage, words(rng, 9) + " " + " ".join(spoiled), None, "", " \n", "1 2 3", "x"]
    texts += ["ñandú " + words(rng, 20).replace("a", "ñ").replace("b", "ú") for _ in range(8)]
    made = [(i, t, "es" if t and "ñ" in t else "en", f"s{i % 3}", len(t or ""), "clash") for i, t in enumerate(texts)]
    return [*made, (None, texts[2], None, None, None, None), (None, None, None, None, None, None)], item


@pytest.fixture(scope="module")
def folders(spark, rows, tmp_path_factory):
    out = []
    for some in (True, False):
        at = str(tmp_path_factory.mktemp("pipeline"))
        spark.createDataFrame(rows[0] if some else [], SCHEMA).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(7, rows[1]), (None, "x"), (8, None)] if some else [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out.append(at)
    return out


def test_stages(spark, rows, folders):
    at = folders[0]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    plain = docs.select(*pipeline.COLUMNS)
    first = pipeline.identify_language(spark, docs, at)
    assert first.columns == list(pipeline.COLUMNS)
    texts = sorted({t for _, t, *_ in rows[0] if t and any(c.isalpha() for c in t)})
    model = language.fit(docs)
    _, score = model.predict(texts)
    sure = {t for t, s in zip(texts, score, strict=True) if s >= pipeline.LEAST_SCORE}
    assert sorted(r.text for r in first.collect()) == sorted(t for _, t, *_ in rows[0] if t in sure)

    second = pipeline.drop_near_duplicates(spark, plain.where("doc_id is not null"), at)
    truth = minhash.brute([(r[0], r[1]) for r in rows[0] if r[0] is not None], 5, 80)
    assert {r.doc_id for r in second.collect()} == {i for i, (_, c) in truth.items() if i == c}

    third = pipeline.remove_repeats(spark, plain, at)
    want = repeats.brute([r[1] for r in rows[0]])
    assert third.columns == list(pipeline.COLUMNS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_chars) for r in third.collect()) == sorted((-1 if r[0] is None else r[0], w[-1].decode(), len(w[-1].decode())) for r, w in zip(rows[0], want, strict=True))

    fourth = pipeline.decontaminate_documents(spark, plain, at)
    found = decontaminate.brute([r[1] for r in rows[0]], [(7, rows[1])])
    assert any(found) and sorted(repr(r.doc_id) for r in fourth.collect()) == sorted(repr(r[0]) for r, f in zip(rows[0], found, strict=True) if not f)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in pipeline.encode_tokens(spark, plain, at).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.round_trip) == (ids, len(ids), True)


def test_awkward_and_empty_tables(spark, folders):
    kept = pipeline.run(spark, folders[0]).collect()
    assert kept and all(r.round_trip for r in kept)
    assert pipeline.run(spark, folders[1]).count() == 0
