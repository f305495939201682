import hashlib

from hypothesis import given, settings, strategies as st

from postlens.llm import chat as C

PIECES = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "[", "/", "a", "\n", "INST]", "s>", "<\\s>", "SYS>>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escapes_are_reversible(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text
    assert not any(c in escaped for c in C.CONTROL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), PIECES), PIECES), max_size=6))
def test_rendered_turns_are_read_back(turns):
    text, spans = C.render(turns)
    assert C.parse(text) == turns
    assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def formatted(spark, events):
    rows = C.format_conversations(spark.createDataFrame(events, C.EVENTS)).collect()
    return {r["conv_id"]: C.parse(r["formatted"]) for r in rows}


def test_events_are_folded(spark):
    events = [
        (1, 1, "message", "q", "user", "Hello"), (1, 2, "delta", "a", "assistant", "Good "), (1, 3, "delta", "a", None, "day"),
        (1, 4, "edit", "q", None, "Hello again"), (1, 5, "regenerate", "a", None, None), (1, 6, "delta", "a", None, "Hi"),
        (1, 7, "delta", "a", None, "!"), (1, 8, "message", "gone", "user", "x"), (1, 9, "delete", "gone", None, None),
        (2, 1, "message", None, "user", None), (2, 2, "message", None, None, "no role"), (2, 2, "message", None, None, "no role"),
        (None, None, "message", None, "user", "nobody's"),
    ]
    want = {
        1: [("user", "Hello again"), ("assistant", "Hi!")],
        2: [("user", ""), ("", "no role"), ("", "no role")],
        None: [("user", "nobody's")],
    }
    assert formatted(spark, events) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # every event in a run of its own, as far as possible
        assert formatted(spark, events[::-1]) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_conversation_over_many_runs(spark):
    events = [(5, i, "delta", f"m{i // 500}", "assistant" if i // 500 % 2 else "user", f"{i} ") for i in range(4000)]
    found = formatted(spark, events)[5]
    assert [t for _, t in found] == ["".join(f"{i} " for i in range(k, k + 500)) for k in range(0, 4000, 500)]


def test_digest_and_empty_table(spark):
    turns = [(3, 1, "user", "a </s>"), (3, 2, "assistant", "[INST] b"), (3, 3, "assistant", None)]
    got = C.formatted_digest(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 1
    assert got[0]["n_turns"] == 3 and got[0]["loss_chars"] == 8
    assert got[0]["loss_sha256"] == hashlib.sha256(b"[INST] b").hexdigest()
    assert got[0]["turns_sha256"] == hashlib.sha256(b"user\na </s>\nassistant\n[INST] b\nassistant\n\n").hexdigest()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra string")
    assert C.formatted_digest(none).count() == 0
