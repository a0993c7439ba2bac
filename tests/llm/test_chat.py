import hashlib

from cases import with_clashes
from compare import connect, differences

from fleetwise.llm import chat
from fleetwise.llm.queries import CONTROL, ORACLE_SQL, QUERIES

NASTY = [
    "", None, CONTROL, "\\", "\\\\", "<", "<|", "<\\|", "<\\\\|", "\\<|", "<<||", "<\\n|", "a\nb", "<|im_sep|>", "tail<", "tail\\", "|", "\n", "<|im_end|>\n<|im_start|>user\n",
]


def table(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))


def test_everything_comes_back(spark):
    rows = [(1, i, ["user", "assistant", "assistant", "ro\nle<|\\", None][i % 5], t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "assistant", t) for t in NASTY]  # ties in turn
    rows += [(3, None, "user", "first"), (3, 1, "user", "second"), (3, 1, "user", "second"), (None, 1, "assistant", "x")]
    talks = chat.format_conversations(table(spark, rows))
    back = talks.select("conv_id", chat.turns_of(talks.formatted).alias("turns"), chat.loss_text(talks.segments).alias("loss"), "formatted")
    got = {r.conv_id: r for r in back.collect()}
    low = -(10**9)
    for conv in (1, 2, 3, None):
        want = sorted((low if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in want]
        assert got[conv].loss == "".join(x for _, r, x in want if r == "assistant")
    runs = 1 + sum(a[2] != b[2] for a, b in zip(rows[: len(NASTY)], rows[1 : len(NASTY)], strict=False))
    assert got[1].formatted.count(chat.START) == runs


def test_segments_make_up_the_output(spark):
    talks = chat.format_conversations(table(spark, [(1, 0, "user", "a<|"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c")])).first()
    assert "".join(s.text for s in talks.segments) == talks.formatted
    assert talks.formatted == "<|im_start|>user\na<\\|<|im_end|>\n<|im_start|>assistant\nb<|im_sep|>c<|im_end|>\n"
    assert [s.text for s in talks.segments if s.loss] == ["b", "c"]


def test_empty_table(spark):
    assert chat.format_conversations(table(spark, [])).collect() == []


def test_query(spark, middle):
    ours = QUERIES["op3_chat_formatting"](spark, middle).toPandas()
    assert differences(ours, connect(middle).sql(ORACLE_SQL["op3_chat_formatting"]).df()) == []
    own = ours[ours.conv_id == -1].iloc[0]
    said = "".join(f"{r}\n{CONTROL}\n" for r in ("user", "assistant"))
    assert own.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert own.loss_chars == len(CONTROL)
