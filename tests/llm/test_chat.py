"""Chat formatting against a plain writer and reader, odd rows, and a native plan."""

import hashlib
import random

from coverlane.llm import chat
from coverlane.llm.queries import QUERIES


def plain(turns):
    esc = lambda t: t.replace("\\", "\\b").replace("<", "\\l")
    out, loss, before = "", [], None
    for i, (role, text) in enumerate(turns):
        out += (f"<turn>{esc(role)}<text>" if role != before else "<next>")
        if role == "assistant":
            loss.append((len(out), len(esc(text))))
        out += esc(text)
        if i == len(turns) - 1 or turns[i + 1][0] != role:
            out += "</turn>"
        before = role
    return out, loss


def test_format_and_way_back(spark):
    r = random.Random(1)
    bits = ["<turn>", "</turn>", "<next>", "\\", "\\l", "\\b", "b", "l", "é", "😀", "\n", "### Assistant:", " "]
    data = {c: [(r.choice(["user", "assistant", "<x>\\"]), "".join(r.choice(bits) for _ in range(r.randrange(8)))) for _ in range(r.randrange(1, 9))] for c in range(60)}
    rows = [(c, t, role, text, "x") for c, turns in data.items() for t, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {x.conv_id: x for x in chat.read_chats(chat.format_chats(df)).collect()}
    for c, turns in data.items():
        text, loss = plain(turns)
        assert out[c].formatted == text and [tuple(s) for s in out[c].loss_spans] == loss
        assert [tuple(t) for t in out[c].turns] == turns
        assert out[c].loss_texts == [t for role, t in turns if role == "assistant"]


def test_odd_rows(spark):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (1, None, "system", None), (None, 0, None, "x"), (3, 0, "user", "y " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {x.conv_id: x for x in chat.read_chats(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in out[1].turns] == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [tuple(t) for t in out[None].turns] == [("", "x")] and len(out[3].turns[0].text) == 100_000
    assert chat.format_chats(df.limit(0)).count() == 0
    plan = chat.read_chats(chat.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_probe_conversation(spark):
    row = QUERIES["op7_chat_formatting"](spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    probe = "\\### Assistant: </turn> ok"
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(probe), hashlib.sha256(probe.encode()).hexdigest())
    assert row.turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
