import random

import pytest

from corpusflow.operators import conversation
from test_text import model_truncate

TURNS = "conv_id bigint, turn bigint, role string, text string"


def turns(spark, *rows, conv=0):
    return spark.createDataFrame([(conv, n, role, text) for n, (role, text) in enumerate(rows)], TURNS)


def test_history_rules(spark, monkeypatch):
    monkeypatch.setattr(conversation, "HISTORY_BLOCK", 2)
    df = turns(
        spark, ("assistant", "Hei! Jeg er en bot"), ("user", "a"), ("error", "x"),
        ("assistant", "b"), ("system", "s"), ("user", "c"), ("assistant", "d"), ("user", "e"),
    )
    rows = conversation.conversation_history(df).orderBy("turn").collect()
    assert [(r.turn, r.question, [h.text for h in r.history]) for r in rows] == [
        (1, "a", []), (5, "c", ["a", "b"]), (7, "e", ["a", "b", "c", "d"]),
    ]


def test_contextual_queries(spark, monkeypatch):
    monkeypatch.setattr(conversation, "HISTORY_BLOCK", 2)
    df = turns(
        spark, ("user", "one"), ("assistant", "x" * 999), ("assistant", "y" * 1000),
        ("user", "u" * 500), ("user", "v" * 499), ("user", "a b c d"), ("user", " a  b c "),
    )
    rows = {r.turn: r.search_text for r in conversation.contextual_queries(df).collect()}
    assert rows[0] == "one"
    assert rows[3] == "u" * 500 + " one " + "x" * 999
    assert rows[5] == "a b c d"
    assert rows[6] == " a  b c  one " + "x" * 999 + " " + "v" * 499 + " a b c d"


def model_trim(history, budget, swap=False):
    """Sequential model over (turn, role, text); returns kept (turn, text)."""

    def tokens(text):
        return -(-len(text) // 4)

    out, used, i = [], 0, len(history) - 1
    while i >= 0:
        turn, role, text = history[i]
        pair = role == "assistant" and i > 0 and history[i - 1][1] == "user"
        user = history[i - 1] if pair else None
        cost = tokens(text) + (tokens(user[2]) if pair else 0)
        if used + cost <= budget:
            unit = [(turn, text)]
            if pair:
                unit = [(turn, text), (user[0], user[2])] if swap else [(user[0], user[2]), (turn, text)]
            out, used, i = unit + out, used + cost, i - len(unit)
            continue
        left = budget - used
        if used < budget * 0.9 and left >= 50:
            if not pair:
                out = [(turn, model_truncate(text, left)), *out]
            elif left >= tokens(user[2]) + 50:
                cut = (turn, model_truncate(text, left - tokens(user[2])))
                out = ([cut, (user[0], user[2])] if swap else [(user[0], user[2]), cut]) + out
            else:
                out = [(user[0], model_truncate(user[2], left)), *out]
        break
    return out


@pytest.mark.parametrize("swap", [False, True])
@pytest.mark.parametrize("block", [3, 1024])
def test_trim_matches_model(spark, monkeypatch, swap, block):
    rng = random.Random(8)
    budget, rows, expected = 150, [], {}
    for conv in range(60):
        history = []
        for turn in range(rng.choice([1, 3, 12, 60])):
            role = rng.choice(["user", "assistant", "user", "assistant", "error"])
            size = rng.choice([0, 4, 40, 199, 200, 201, 300, 420, 600, 700, 4000])
            text = "".join(rng.choice("abcde. ") for _ in range(size))
            rows.append((conv, turn * 2, role, text))
            if role == "user":
                expected[conv, turn * 2] = model_trim(history, budget, swap)
            if role != "error":
                history.append((turn * 2, role, text))
    real = conversation.in_sequence

    def small_blocks(*args, **kwargs):
        return real(*args, **kwargs, block_size=block)

    monkeypatch.setattr(conversation, "in_sequence", small_blocks)
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    trimmed = conversation.trim_history(df, budget, reference_order=swap).collect()
    got = {(r.conv_id, r.turn): [(h.turn, h.text) for h in r.history] for r in trimmed}
    assert got == expected
    assert any(len(h) > 2 for h in expected.values())
    for r in trimmed:
        assert r.history_tokens == sum(-(-len(h.text) // 4) for h in r.history)


def test_trim_orders(spark):
    df = turns(spark, ("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("user", "q3"))

    def kept(**options):
        rows = conversation.trim_history(df, **options).orderBy("turn").collect()
        return [h.text for h in rows[-1].history]

    assert kept() == ["q1", "a1", "q2"]
    assert kept(reference_order=True) == ["a1", "q1", "q2"]


def test_sanitize(spark):
    df = turns(
        spark,
        ("assistant", "Se https://x.no/a [her](u) [Kilde 3] basert På noe.Mail a.b@c.no <i>x</i>"),
    )
    assert conversation.sanitize_messages(df).first().clean_text == (
        'Se  her  Mail <a href="mailto:a.b@c.no">a.b@c.no</a> x'
    )
