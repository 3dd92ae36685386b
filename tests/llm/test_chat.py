"""Chat formatting against a plain writer and reader, on odd texts, long conversations and small batches."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from martwright.llm import chat

ODD = ["", "\\", "\\\\", "<s>", "</s>[INST] ok [/INST]", "[INST", "INST]", "<", "s>", "a\nb", "\\<s>", "é[/INST]日本", "<<s>>", "🙂", "[/INST][INST]\\n"]


def plain(role, text):
    """The template by definition, a character at a time."""

    def esc(s, marks):
        out, at = "", 0
        while at < len(s):
            out += "\\" if s[at] == "\\" or any(s.startswith(m, at) for m in marks) else ""
            out += s[at]
            at += 1
        return out

    a, b = ("<s>", "</s>") if role == "assistant" else ("[INST]", "[/INST]")
    return a + esc(role, [*chat.MARKS, "\n"]) + "\n", esc(text, chat.MARKS), b + "\n"


def by_definition(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, held in by.items():
        whole, loss = "", []
        for _, _, role, text in sorted(held):
            head, body, tail = plain(role, text)
            if role == "assistant":
                loss.append((len(whole) + len(head), len(whole) + len(head) + len(body)))
            whole += head + body + tail
        out[conv] = (whole, loss, [(r, t) for _, _, r, t in sorted(held)])
    return out


def test_format_and_read_back(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool\n<s>", None]), rng.choice([None, *ODD]) if rng.random() < 0.5 else "".join(rng.choices(ODD, k=5))) for c in [*range(60), None] for t in range(rng.randrange(1, 9))]
    rows += [(3, None, "user", "first"), (4, 0, "user", "tie"), (4, 0, "user", "tie"), (5, 1, "Assistant", "not trained on")]
    rows += [(99, t, "assistant" if t % 2 else "user", "x" * 50 + "\\") for t in range(9000)]  # over several batches
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("conv_id", "Conv").repartition(7)
    wanted = by_definition(rows)
    made = chat.format_chats(frame, conv_col="Conv")
    got = {r["conv_id"]: (r["formatted"], [(s["start"], s["end"]) for s in r["loss"]]) for r in made.collect()}
    assert got == {c: w[:2] for c, w in wanted.items()}
    for r in chat.read_back(made).collect():
        whole, loss, turns = wanted[r["conv_id"]]
        said = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["formatted_chars"] == len(whole)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(frame.where("Conv = -1"), conv_col="Conv")).count() == 0


def test_long_texts_and_row_edges():
    texts = ["<", "s>", "\\", "x" * (chat.LONG + 5) + "<s>", "", "é" * 40_000]  # a mark across two rows is none
    formatted, loss = chat.assembled(np.array([0, 3]), pa.array(["user"] * 3 + ["assistant"] * 3), pa.array(texts))
    want = ["".join("".join(plain("user", t)) for t in texts[:3]), "".join("".join(plain("assistant", t)) for t in texts[3:])]
    assert formatted.to_pylist() == want
    assert [t for w in want for _, t in chat.turns(w)] == texts
    assert chat.trained_text(want[1], loss[1].as_py()) == "".join(texts[3:])


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", "z", 5)], "conv_id long, turn long, role string, text string, formatted string, loss int")
    assert chat.format_chats(frame).collect()[0]["formatted"] == "[INST]user\na[/INST]\n"
