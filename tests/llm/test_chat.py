"""Chat formatting: exact round trips and digests against a plain computation."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import chat as m

CHAT = m.codec(*m.default_vocabulary())
PIECES = st.lists(st.one_of(st.sampled_from(["\\", "#", "##", "###", ": ", ":", "</turn>", "\n", " ", "<|endoftext|>", "é", "\\\\#"]), st.text(max_size=5))).map("".join)


@settings(max_examples=300, deadline=None)
@given(role=PIECES, text=PIECES)
def test_round_trip(role, text):
    assert m.unescape(m.escape(text)) == text
    ids, mask = CHAT.assemble(role, text)
    assert CHAT.parse(ids) == (role, text) and len(mask) == len(ids) and not any(mask)
    assert CHAT.text_of(ids) == f"### {m.escape(role)}: {m.escape(text)}</turn>\n"
    ids, mask = CHAT.assemble("assistant", text)
    assert m.unescape(CHAT.plain([i for i, k in zip(ids, mask) if k])) == text


def plain(turns):
    turns = [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0], x[1] or ""))]
    said = "".join(t for r, t in turns if r == "assistant")
    return (
        len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(),
        sum(len(f"### {m.escape(r)}: {m.escape(t)}</turn>\n") for r, t in turns),
    )


def test_query(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        want.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    odd = r"\### Assistant: </turn> ok"
    want[-7] = [(0, "user", odd), (1, "assistant", odd)]
    got = {r.conv_id: tuple(r)[1:] for r in m.op8_chat(spark, sf_dir).collect()}
    assert got == {k: plain(v) for k, v in want.items()}


def test_edges(spark):
    rows = [(1, 2, "assistant", None, 0), (1, 1, None, "x", 0), (1, None, "user", "", 1), (None, 1, "assistant", "é" * 5000, 2), (1, 2, "assistant", "b", 3), (2, 1, "user", "same", 4), (2, 1, "user", "same", 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: tuple(r)[1:] for r in m.read_back(m.format_turns(df)).collect()}
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append((t, r, x))
    assert {k: v[0] for k, v in got.items()} == {1: 4, 2: 2, None: 1}
    assert got[2] == plain(want[2]) and got[None] == plain(want[None])
    assert m.read_back(m.format_turns(df.limit(0))).count() == 0


def test_ties_are_ordered_by_text(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "c"), (1, 1, None, "z"), (1, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = m.read_back(m.format_turns(df)).collect()
    assert [tuple(r)[1:] for r in got] == [plain([(t, r or "", x) for _, t, r, x in [rows[4], rows[3], rows[1], rows[0], rows[2]]])]


def test_long_conversation_is_cut_into_ranges(spark):
    df = spark.createDataFrame([(k // 400, k, "assistant" if k % 2 else "user", f"word {k} " * (k % 9)) for k in range(1000)], "conv_id long, turn long, role string, text string")
    made = m.format_turns(df)
    assert {r.conv_id: tuple(r)[1:] for r in m.read_back(made).collect()} == {c: plain([(r.turn, r.role, r.text) for r in df.collect() if r.conv_id == c]) for c in range(3)}
    for c in range(3):
        rows = sorted((r for r in made.collect() if r.conv_id == c), key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(len(x.ids) for x in rows[:k]) for k in range(len(rows))]


def test_places_are_running_sums(spark):
    df = spark.createDataFrame([(1, k, "user", "word " * k) for k in range(6)], "conv_id long, turn long, role string, text string")
    rows = sorted(m.format_turns(df).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(len(x.ids) for x in rows[:k]) for k in range(6)]
