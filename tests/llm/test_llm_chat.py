"""Folding event logs and reading formatted conversations back."""

import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from cueglass.llm import chat

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"
ROWS = "conv_id long, turn long, role string, text string"


def fold(events):
    """Final (role, text) list of one conversation, event by event in order of seq."""
    turns = {}
    for _, turn, _, kind, role, text in sorted(events, key=lambda e: e[2]):
        if kind in (chat.EDIT, chat.REGENERATE):
            turns = {t: m for t, m in turns.items() if t <= turn}
            old = turns.get(turn, [role, ""])
            turns[turn] = [old[0], text or "" if kind == chat.EDIT else ""]
        else:
            turns.setdefault(turn, [role, ""])[1] += text or ""
    return [tuple(turns[t]) for t in sorted(turns)]


def digest(turns):
    whole = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
    learned = "".join(text or "" for role, text in turns if role == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def formatted(spark, events):
    return {r.conv_id: r for r in chat.read_back(chat.render(spark.createDataFrame(events, EVENTS))).collect()}


def test_random_logs(spark):
    rng = random.Random(4)
    logs = {}
    for conv in range(30):
        seqs = rng.sample(range(1000), 40)
        logs[conv] = [
            (conv, turn := rng.randrange(6), seq, rng.choice([chat.DELTA] * 5 + [chat.EDIT, chat.REGENERATE]),
             "assistant" if turn % 2 else "user", rng.choice(["a", "é</turn>", "\\#", "", None, "### x: "]))
            for seq in seqs
        ]
    events = [e for log in logs.values() for e in log]
    rng.shuffle(events)
    got = formatted(spark, events)
    for conv, log in logs.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digest(fold(log))


@given(st.text(), st.text())
def test_control_strings_are_reversible(role, text):
    body = chat.escape(text)
    assert chat.unescape(body) == text
    name = chat.escape(role).replace(":", r"\:")
    assert [tuple(map(chat.unescape, t)) for t in chat._TURN.findall(f"### {name}: {body}</turn>\n" * 2)] == [(role, text)] * 2


def test_rows(spark):
    odd = r"\### Assistant: </turn> ok"
    rows = [
        (1, 1, "assistant", odd), (1, 0, "user", odd), (2, 0, None, None), (None, 0, "assistant", "n"),
        (3, 0, "user", "same"), (3, 0, "user", "same"), (4, None, "assistant", "x" * 3_000_000), (5, 0, "a: b", ": "),
    ]
    events = chat.events_of_rows(spark.createDataFrame(rows, ROWS))
    rendered = chat.render(events)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(rendered).collect()}
    assert got == {
        1: digest([("user", odd), ("assistant", odd)]), 2: digest([(None, None)]), None: digest([("assistant", "n")]),
        3: digest([("user", "same")] * 2), 4: digest([("assistant", "x" * 3_000_000)]), 5: digest([("a: b", ": ")]),
    }
    chunks = {(r.conv_id, r.part): r for r in rendered.collect()}
    assert chunks[1, 1].start == len(chunks[1, 0].chunk)
    assert chunks[1, 0].loss_from is None


def test_empty_table_and_clashing_columns(spark):
    assert chat.read_back(chat.render(spark.createDataFrame([], EVENTS))).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "a", 1, "x")], ROWS + ", seq long, kind string")
    assert [r.n_turns for r in chat.read_back(chat.render(chat.events_of_rows(rows))).collect()] == [1]
