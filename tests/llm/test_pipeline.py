from __future__ import annotations

import os
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import language
from plumbline.llm.secrets import DISTINCT_CHARACTERS, MANY_OWNERS, PLACEHOLDER
from tests.llm import test_decontaminate, test_secrets, test_simhash

FOLDER = "/root/testdata/sf0.001"


def redacted(rows: list) -> dict[int, str]:
    import re

    owners = defaultdict(set)
    found = {r.doc_id: test_secrets.brute(r.text) for r in rows}
    for r in rows:
        for *_, value in found[r.doc_id]:
            owners[value].add(r.source)

    def live(v: str) -> bool:
        mixed = re.search("[A-Za-z]", v) and re.search("[0-9]", v) and len(set(v)) >= DISTINCT_CHARACTERS
        return bool(mixed and len(owners[v]) < MANY_OWNERS and not re.search(PLACEHOLDER, v))

    out = {}
    for r in rows:
        text, at = "", 0
        for start, _, end, _, value in found[r.doc_id]:
            if live(value):
                if start >= at:
                    text += r.text[at:start] + "[SECRET]"
                at = max(at, end)
        out[r.doc_id] = text + r.text[at:] if at else r.text
    return out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_rows_equal_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judge = language.Compressors(language.learn(language.training_part(table)))
    rows = [r for r in table.collect() if judge.guess(r.text)[0] != "und" and judge.guess(r.text)[2] >= language.MIN_MARGIN]
    first = {component for _, _, component in test_simhash.brute([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if r.doc_id in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[q : q + min(10, len(w))]) for _, t in items for w in [test_decontaminate.words(t)] for q in range(max(0, len(w) - 9)) or [0] if w}

    def hit(text: str) -> bool:
        w = test_decontaminate.words(text)
        return any(tuple(w[p : p + n]) in windows for n in {len(x) for x in windows} for p in range(len(w) - n + 1))

    rows = [r for r in rows if not hit(r.text)]
    clean = redacted(rows)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == [*table.columns, "ids"]
    out = {r.doc_id: r for r in got.collect()}
    assert set(out) == set(clean) and len(out) < table.count()
    for r in rows:
        o = out[r.doc_id]
        assert o.text == clean[r.doc_id] and o.n_chars == len(o.text) and (o.lang, o.source) == (r.lang, r.source)
        assert o.ids == library.encode(o.text, add_special_tokens=False).ids
