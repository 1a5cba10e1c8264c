from __future__ import annotations

import os
import random
import zlib

import pytest
import zstandard

from plumbline.llm import language
from plumbline.llm.queries import op8_language_id

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    true = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op8_language_id(spark, FOLDER).collect()
    assert len(got) == len(true)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and true[r.doc_id][0]]
    assert sum(r.lang_pred == true[r.doc_id][0] for r in held) / len(held) > 0.97
    assert sum(r.margin < language.MIN_MARGIN for r in got) / len(got) < 0.02


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_short_texts_are_told_by_their_bytes_not_by_the_alphabet(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judge = language.Compressors(language.learn(language.training_part(documents)))
    held = documents.where(language.held_out()).where("lang is not null and length(text) > 400").orderBy("doc_id").collect()
    rng = random.Random(11)
    for characters, least in ((8, 0.75), (16, 0.93), (39, 0.97)):
        right = 0
        for r in held:
            words = r.text.split()
            right += judge.guess(" ".join(words[rng.randrange(len(words) - 20) :])[:characters])[0] == r.lang
        assert right / len(held) > least, characters


def test_smallest_wins_and_ties_are_rejected(spark):
    learnt = {"a": b"the quick brown fox jumps over the lazy dog " * 20, "b": b"portez ce vieux whisky au juge blond " * 20}
    rows = [(1, "The quick brown fox"), (2, "PORTEZ ce vieux, whisky"), (3, "0123 456"), (4, None), (5, "zqj")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(frame, learnt).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["a", "b", "und", "und", "a"]
    assert got[5].margin == 0 and got[3].score == got[4].score == 0 and got[5].score == 0.5
    assert sorted(r.doc_id for r in language.confident(frame, learnt).collect()) == [1, 2]
    judge = language.Compressors(learnt)
    raw = zstandard.ZstdCompressionDict(learnt["a"], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
    blocks = [b"the lazy dog " * 400][0]
    expected = sum(len(plain.compress(blocks[i : i + language.BLOCK_BYTES] + language.FILLER)) for i in range(0, len(blocks), language.BLOCK_BYTES))
    assert abs(judge.sizes(blocks)[0] - expected) <= 8


def test_learning_is_bounded_and_ignores_copies_and_order(spark):
    rows = [(i, f"mot {i} " * 30, "fr") for i in range(50)] + [(99, "copy " * 100, "en")] * 200 + [(7, "x", None), (8, "1 2", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = language.learn(frame, dictionary_bytes=600, sample_rows=10)
    assert sorted(learnt) == ["en", "fr"] and all(len(v) <= 600 for v in learnt.values())
    assert learnt == language.learn(frame.repartition(7), dictionary_bytes=600, sample_rows=10)


def test_few_long_texts_fill_the_dictionary_and_banners_do_not(spark):
    rng = random.Random(3)

    def words(letters: str) -> list[str]:
        return ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(2000)]

    def text(vocabulary: list[str], n: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    rare, often = words("aeiklmnoprstu"), words("aeiklmnoprstu")
    banner = "this banner stands before every text of the source " * 12
    train = [(i, banner + text(rare, 8000), "rare") for i in range(5)]
    train += [(i, banner + text(often, 300), "often") for i in range(10, 410)]
    learnt = language.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert len(learnt["rare"]) > 0.9 * language.DICTIONARY_BYTES
    assert all(v.count(b"banner") < 0.05 * len(v.split()) for v in learnt.values())
    held = [(i, banner + text(rare if i % 2 else often, 150), "rare" if i % 2 else "often") for i in range(60)]
    judge = language.Compressors(learnt)
    assert sum(judge.guess(t)[0] == lang for _, t, lang in held) >= 57


def test_odd_rows_and_empty_tables(spark, odd_documents):
    learnt = language.learn(odd_documents.limit(0))
    assert learnt == {}
    frame = odd_documents.withColumnRenamed("n_words", "score")
    got = language.identify(frame, learnt).collect()
    assert len(got) == odd_documents.count() and {r.lang_pred for r in got} == {"und"}
    known = language.learn(odd_documents)
    assert language.identify(frame.limit(0), known).count() == 0
    kept = language.confident(frame, known)
    assert kept.columns == frame.columns and kept.where("text is null or text = ''").count() == 0


def test_a_worker_holds_the_tables_of_one_operator():
    from plumbline.llm import rows

    rows._held.clear()
    first = rows.held("one", object)
    assert rows.held("one", object) is first
    rows.held("two", object)
    assert list(rows._held) == ["two"] and rows.held("one", object) is not first
