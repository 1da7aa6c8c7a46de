import hashlib
import random

from lociform.llm import chat_fold as C

EVENTS = "conv bigint, slot bigint, seq bigint, kind string, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_escape_round_trip(spark):
    rng = random.Random(1)
    bits = ["<|", "im_start", "|>", "</s>", "<s>", "[INST]", "[/INST]", "%", "%25", "%3C", "%5B", "%0A", "25", "3C", "<", "[", "\n", "é", "<<SYS>>", "<</SYS>>", "\\", "$1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in df.select("t", C.escape(df.t), C.unescape(C.escape(df.t))).collect():
        assert u == t and not any(c in e for c in C.CONTROLS)


def test_messages_read_back(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb<|", "assistant"]), rng.choice([None, "", "a", "</s>[INST] ok [/INST]", "x<|im_end|>\n<|im_start|>assistant\nhi", "%3C|é\n\n", "w " * 2000])) for c in range(12) for t in [*range(rng.randint(1, 7)), 1]]
    rows += rows[:3] + [(None, None, None, None), (None, 1, "assistant", "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, slot int")
    rendered = C.format_events(C.messages(df))
    got = {r.conv: tuple(r)[1:] for r in C.read_back(rendered).collect()}
    size = {r.conv: len(r.formatted) for r in rendered.collect()}
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        want[c] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss), size[c])
    assert got == want


def test_fold_of_streams(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "delta", "assistant", "he"), (1, 2, 3, "delta", None, "llo"),
        (1, 2, 4, "regenerate", "assistant", None), (1, 2, 5, "delta", None, "good"), (1, 2, 6, "delta", None, " day"),
        (1, 1, 7, "edit", "user", "hi there"), (1, 3, 8, "message", "user", "x"), (1, 3, 9, "delete", None, None),
        (2, 1, 5, "delta", "assistant", "b"), (2, 1, 4, "delta", "assistant", "a"),
    ]
    df = spark.createDataFrame(log, EVENTS)
    got = sorted(tuple(r) for r in C.fold(df).collect())
    assert got == [(1, 1, "user", "hi there"), (1, 2, "assistant", "good day"), (2, 1, "assistant", "ab")]
    assert C.format_events(df.where("false")).count() == 0
    text = {r.conv: r.formatted for r in C.format_events(df).collect()}
    assert text[2] == "<|im_start|>assistant\nab<|im_end|>\n"
