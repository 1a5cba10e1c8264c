from __future__ import annotations

import random
import re
from collections import Counter

from plumbline.llm import quality


def brute(text: str | None) -> dict[str, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeated = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(repeated),
        "n_distinct_words": len(set(words)),
        "n_capitals": len(re.findall("[A-Z]", text)),
        "n_small_letters": sum("a" <= c <= "z" or c >= "\x80" for w in words for c in w),
    }


def test_measures_equal_brute_force(spark, odd_documents):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["\n".join(rng.choice(["x y", "", " ", "É#"]) for _ in range(9)) for _ in range(50)]
    for text in texts:
        assert dict(zip(quality.MEASURES, quality.measure(text.encode()), strict=True)) == brute(text)
    rows = quality.ledger(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        if len(r.text or "") < 10_000:
            assert {m: r[m] for m in quality.MEASURES} == brute(r.text)
    assert quality.ledger(odd_documents.limit(0)).count() == 0


def test_policies_and_ablations_are_bitwise(spark):
    rows = [(i, f) for i, f in enumerate([0, 0, 1, 2, 3, 4, 5, 8, 1 << 7])]
    frame = spark.createDataFrame(rows, "doc_id long, failed long")
    kept = quality.apply_policies(frame, {"v1": 3, "v2": 255}).collect()
    assert [(r.kept_v1, r.kept_v2) for r in kept] == [(not f & 3, not f & 255) for _, f in rows]
    got = {r.rule: tuple(r)[1:] for r in quality.ablations(frame, 3).collect()}
    for rule in quality.RULES[:2]:
        fails = [f & 3 for _, f in rows]
        alone = sum(f == rule.mask for f in fails)
        assert got[rule.name] == (sum(bool(f & rule.mask) for f in fails), alone, fails.count(0) + alone)
    assert len(got) == 2
