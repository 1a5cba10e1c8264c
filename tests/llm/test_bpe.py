from __future__ import annotations

import hashlib
import random
import struct
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.WordTokenizer(PATH)


def ids_of(library, text: str) -> list[int]:
    return library.encode(text, add_special_tokens=False).ids


def test_small_automaton_follows_the_merges_in_order():
    """Base a=0, b=1; merges aa=2, ab=3, (aa)(ab)=4, (aa)(aa)=5."""
    merges = [(0, 0, 2), (0, 1, 3), (2, 3, 4), (2, 2, 5)]
    spelling = {0: (0,), 1: (1,), 2: (0, 0), 3: (0, 1), 4: (0, 0, 0, 1), 5: (0, 0, 0, 0)}
    automaton = bpe.Automaton(merges, spelling)

    def by_merging(symbols: list[int]) -> list[int]:
        ids = list(symbols)
        for left, right, merged in merges:
            out: list[int] = []
            for x in ids:
                out.append(x)
                if out[-2:] == [left, right]:
                    out[-2:] = [merged]
            ids = out
        return ids

    for size in range(12):
        for code in range(1 << size):
            symbols = [code >> k & 1 for k in range(size)]
            assert automaton.encode(symbols) == by_merging(symbols)


def test_every_character(coder, library):
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c <= 0xDFFF:
            text = f"a{chr(c)}{chr(c)}b"
            assert coder.encode(text).tolist() == ids_of(library, text), hex(c)


def test_random_texts(coder, library):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCéßΣ漢'0!. \n\x1c"
    for _ in range(20_000):
        some = letters[: rng.choice([2, 3, 26, len(letters)])]
        text = "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 4, 12, 60])))
        ids = ids_of(library, text)
        assert coder.encode(text).tolist() == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_special_tokens_and_long_words(coder, library):
    for text in ["a<|endoftext|>b", "<|ENDOFTEXT|>", "<|startoftext|><|endoftext|>", "x" * 4000, "ab" * 3000, "ΟΔΟΣ"]:
        assert coder.encode(text).tolist() == ids_of(library, text)


def test_generations_of_words_and_arcs(library, monkeypatch):
    for name in ("WORDS_HELD", "RUNS_HELD", "ARCS_HELD"):
        monkeypatch.setattr(bpe, name, 3)
    small = bpe.WordTokenizer(PATH)
    text = "onebone twobone, three four five onebone six twobone, three four. seven eight nine five"
    for _ in range(2):
        assert small.encode(text).tolist() == ids_of(library, text)
    assert len(small.known) <= 3 and len(small.packed) <= 3 and len(small.automaton.table) <= 3


def test_columns_and_odd_rows(spark, odd_documents, library):
    frame = odd_documents.withColumnRenamed("lang", "ids")
    coded = bpe.decode(bpe.encode(frame, PATH), PATH)
    assert sorted(coded.columns) == sorted([*frame.columns, "decoded"])
    rows = coded.collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert r.ids == ids_of(library, r.text or "")
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd_documents, PATH).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == {
        (r.doc_id, len(r.ids), sha(struct.pack(f"<{len(r.ids)}I", *r.ids)), sha(r.decoded.encode())) for r in rows
    }
    assert bpe.digests(odd_documents.limit(0), PATH).count() == 0


def test_transitions_are_kept_once_and_within_bounds(monkeypatch):
    merges, spelling = [(0, 1, 3), (3, 2, 4), (1, 2, 5)], {0: (0,), 1: (1,), 2: (2,), 3: (0, 1), 4: (0, 1, 2), 5: (1, 2)}
    rng = random.Random(4)
    words = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(200)]
    whole = bpe.Automaton(merges, spelling)
    want = [whole.encode(w) for w in words]
    assert all(sum((spelling[t] for t in ids), ()) == tuple(w) for ids, w in zip(want, words))
    assert whole.moves and all(whole._move(key) == found for key, found in list(whole.moves.items()))
    monkeypatch.setattr(bpe, "ARCS_HELD", 2)
    small = bpe.Automaton(merges, spelling)
    assert [small.encode(w) for w in words] == want and len(small.moves) <= 2 and len(small.table) <= 2
