from __future__ import annotations

import hashlib
import random

import pytest

from plumbline.llm import chat
from plumbline.llm.chat import DEFAULT, OTHER, Field, Template

CONTROLS = DEFAULT.controls


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows: list[tuple]) -> dict:
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_escaped_texts_come_back_and_hold_no_control_string():
    rng = random.Random(3)
    parts = [*CONTROLS, "\\", "\\\\", "\\.", "<", "[", "/", "s>", "INST]", "a", "é", "\U0001f600", " ", "\n"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool", "[ROLE]", "\\"]), "".join(rng.choices(parts, k=rng.randrange(12)))) for _ in range(3)]
        for _, text in turns:
            assert not any(c in DEFAULT.escape(text) for c in CONTROLS)
            assert DEFAULT.unescape(DEFAULT.escape(text)) == text
        written = "".join(s for i, (r, t) in enumerate(turns) for s, _ in DEFAULT.segments(r, t, i == 0))
        assert list(DEFAULT.read(written)) == turns


@pytest.mark.parametrize("text", ["x", "[INST]a", "[INST]a[/SYS]", "<s>x[INST]a[/INST]", "[INST]a[/INST]x", "[/INST]"])
def test_foreign_text_is_refused(text):
    with pytest.raises(ValueError):
        list(DEFAULT.read(text))


@pytest.mark.parametrize("controls", [("[", "]]"), ("[A", "[AB"), ("[A", "<[A"), ("[\\", "<B"), ("<s>", "<B")])
def test_unfit_templates_are_refused(controls):
    first, last = controls
    with pytest.raises(ValueError):
        Template("<s>", {OTHER: (first, Field("role"), "<C", Field("text"), last)}, {}, ())
    with pytest.raises(ValueError):
        Template("<s>", {OTHER: ("[A", Field("text"), "[B")}, {}, ())


def test_formatting_equals_brute_force(spark):
    rng = random.Random(4)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = [None, "", "plain", "</s>[INST] ok [/INST]", "a\\b", "x" * 50_000, "é\U0001f600"]
    rows = [(rng.choice([None, *range(-3, 40)]), rng.choice([None, 0, 1, 2, 3, 3]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(7, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(3000)]  # one long conversation
    rows += rows[:30]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = chat.format_conversations(frame)
    want = brute(rows)
    for got in (chat.read_back(formatted, shuffle=False).collect(), chat.read_back(formatted.repartition(3)).collect()):
        assert {r.conv_id: tuple(r)[1:5] for r in got} == want and len(got) == len(want)
    written = formatted.collect()
    assert sum(r.formatted_chars for r in got) == sum(len(s.text) for r in written for s in r.segments)
    assert sum(s.loss for r in written for s in r.segments) == sum(role == "assistant" for _, _, role, _ in rows)
    assert {r.state for r in written} <= {*DEFAULT.moves}


def test_order_of_turns_is_judged_by_the_machine(spark):
    cases = {
        "system user assistant user assistant": (0, True),
        "user assistant": (0, True),
        "user": (0, False),
        "assistant user assistant": (1, True),
        "user user assistant": (1, True),
        "user system user assistant": (1, True),
        "user tool assistant": (1, True),
        "system assistant": (1, True),
    }
    rows = [(i, j, role, "x") for i, c in enumerate(cases) for j, role in enumerate(c.split())]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_refused, r.complete) for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_own_template_names_and_empty_tables(spark):
    form = ("(R)", Field("role"), "<T>", Field("text", loss=True), "~E")
    template = Template("{B}", {OTHER: form}, {"start": {"a": "start"}}, ("start",))
    rows = [("c", 1.5, "a", "(R)x", 1), ("c", 0.5, None, None, 2)]
    frame = spark.createDataFrame(rows, "id string, at double, who string, said string, segments int")
    names = {"conv_id": "id", "turn": "at", "role": "who", "text": "said"}
    formatted = chat.format_conversations(frame, template, **names)
    assert formatted.columns == ["conv_id", "position", "state", "in_order", "segments"]
    (row,) = chat.read_back(formatted, template).collect()
    assert (row.conv_id, row.n_turns, row.turns_sha256, row.loss_chars, row.n_refused) == ("c", 2, sha("\n\na\n(R)x\n"), 4, 1)
    assert chat.format_conversations(frame.limit(0), template, **names).count() == 0
    assert chat.read_back(formatted.limit(0), template).count() == 0
