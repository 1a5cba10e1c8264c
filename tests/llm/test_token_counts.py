from __future__ import annotations

import base64
import os
import uuid
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import token_counts as t
from plumbline.llm.queries import op3_token_counts
from plumbline.session import shared_folder

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def coder(name: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture
def ledger(spark):
    return t.Ledger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    names = ["byte_bpe_50k", "byte_bpe_multi_50k"]
    coders = {n: coder(n) for n in names}
    seen, docs, tokens = set(), Counter(), Counter()
    for r in rows:
        if (r.text or "") in seen:
            continue
        seen.add(r.text or "")
        for n in names:
            key = (r.source, r.lang, n)
            docs[key] += 1
            tokens[key] += len(coders[n].encode_ordinary(r.text or "")) + (n == names[0])
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in op3_token_counts(spark, FOLDER).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}


def test_batches_count_once_and_add_up(spark, ledger):
    load = spark.createDataFrame([("insert", "a", None, "v1", 10, None)] * 3 + [("insert", None, "en", "v1", None, None)], SCHEMA)
    change = spark.createDataFrame(
        [("delete", "a", None, "v1", 10, None), ("revise", "a", None, "v1", 7, 10), ("odd", "a", None, "v1", 5, None)], SCHEMA
    )
    assert ledger.commit("1", load) and ledger.commit("2", change)
    before = sorted(map(tuple, ledger.totals().collect()), key=str)
    assert before == sorted([("a", None, "v1", 2, 17), (None, "en", "v1", 1, 0)], key=str)
    assert not ledger.commit("1", load) and not ledger.commit("2", change)
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == before
    assert [tuple(r) for r in ledger.totals(["tokenizer"]).collect()] == [("v1", 3, 17)]
    assert ledger.commit("3", load.limit(0)) and not ledger.commit("3", load)
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == before


def test_lost_and_doubled_attempts_do_not_count(spark, ledger):
    load = spark.createDataFrame([("insert", "a", "en", "v1", 10, None)], SCHEMA)
    row = t.signed(load).selectExpr("'1' batch", "'zz' attempt", *t.KEYS, *t.SUMS)
    row.write.mode("append").parquet(f"{ledger.folder}/deltas")  # a driver lost before its commit
    assert ledger.totals().count() == 0
    assert ledger.commit("1", load)
    spark.createDataFrame([("1", "zz")], ledger.schemas["commits"]).write.mode("append").parquet(f"{ledger.folder}/commits")
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v1", 1, 10)]


def test_counting_odd_rows(spark, odd_documents):
    files = {"n_words": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    counted = t.count_tokens(odd_documents, files, public_tokenizers.PATTERN)
    own = coder("byte_bpe_50k")
    rows = counted.collect()
    assert len(rows) == odd_documents.count() and counted.columns.count("n_words") == 1
    assert all(r.n_words == len(own.encode_ordinary(r.text or "")) for r in rows)
    assert t.count_tokens(odd_documents.limit(0), files, public_tokenizers.PATTERN).count() == 0
