import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from factgraph.llm import chat

KIND = "conv_id long, turn long, role string, text string, example int, loss_start int, _conv int, _turns int"
PIECES = st.lists(st.sampled_from(["<", "|", ">", "&", "amp;", "lt;", "nl;", "\n", "<|im_end|>", "<|im_start|>", "a", "é", "🙂", "\\"]), max_size=8).map("".join)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], KIND)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    found = chat.digest(chat.read_back(chat.format_chats(frame(spark, rows)))).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == expected(rows)


def test_round_trip(spark):
    check(spark, [
        (1, 0, "system", "be & do <|"), (1, 1, "user", "hi"), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\nno"), (1, 3, "user", "bye"),
        (2, 0, "user", None), (3, 0, "assistant", ""), (3, 1, "assistant", "x"), (4, 1, None, "r"), (4, None, "a\nb", "null turn first"),
        (5, 0, "assistant", "same"), (5, 0, "assistant", "same"), (None, 0, "assistant", "no id"), (6, 0, "user", "&lt;| &amp; &nl; <<|||>"),
        (7, 0, "assistant", "long " * 20_000),
    ])


def test_many_odd_texts_round_trip(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 4), st.one_of(PIECES, st.just("assistant")), PIECES), min_size=150, max_size=250))
    def run(rows):
        check(spark, rows)

    run()


def test_one_example_for_each_reply(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(5)]
    examples = chat.format_chats(frame(spark, rows)).orderBy("example").collect()
    assert [e.target_turn for e in examples] == [1, 3, None]
    for e in examples[:2]:
        assert e.text[e.loss_start : e.loss_end] == f"t{e.target_turn}" and e.text.endswith(f"t{e.target_turn}<|im_end|>\n")
        assert e.text.count(chat.START) == e.target_turn + 1
    assert examples[2].loss_start == examples[2].loss_end == len(examples[2].text)


def test_empty_table(spark):
    assert chat.digest(chat.read_back(chat.format_chats(frame(spark, [])))).count() == 0
