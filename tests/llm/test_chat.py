import hashlib
import json
import random

from bulwark.llm import chat
from bulwark.llm.op4_chat import PROBE

ROW = "conv_id long, turn long, role string, text string"
NASTY = ["", "\\", "\\\\", "<|", "<\\|", "\\<|", "<|im_end|>\n", "<|im_start|>user\n", "a<", "|>", "<<||>>", "\n\n", PROBE, "x\\n", "é\U0001f600<|"]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_escapes_are_reversible():
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice("\\<|n\n>a") for _ in range(rng.randint(0, 12)))
        assert "<|" not in chat.escape(t)
        assert chat.unescape(chat.escape(t)) == t
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_round_trip_with_control_strings(spark):
    rng = random.Random(1)
    convs = {c: [(rng.choice(["user", "assistant", "system", "odd\nrole", "<|im_end|>"]), rng.choice(NASTY) * rng.randint(0, 3)) for _ in range(rng.randint(1, 9))] for c in range(40)}
    convs[99] = [("user" if i % 2 else "assistant", f"turn {i} " + "y" * 700) for i in range(400)]  # several parts
    convs[100] = [("assistant", "z" * 200_000)]
    rows = [(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    rng.shuffle(rows)
    parts = chat.format_turns(spark.createDataFrame(rows, ROW), 5)
    got = {r["conv_id"]: r for r in chat.read_back(parts).collect()}
    whole = {}
    for r in sorted(parts.collect(), key=lambda r: (r["conv_id"], r["part"])):
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["formatted"]
    for c, ts in convs.items():
        said = "".join(t for r, t in ts if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(ts), digest(ts))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(whole[c]) and whole[c].count("<|im_start|>") == len(ts)
    assert max(len(r["formatted"]) for r in parts.where("conv_id = 99").collect()) <= chat.PART


def test_nulls_ties_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", None, 5), (1, 0, None, "b", 5), (1, 0, None, "a", 5), (1, 0, None, "a", 5), (None, None, "assistant", "x", 5)], ROW + ", formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1]["turns_sha256"] == digest([("", "a"), ("", "a"), ("", "b"), ("user", "")])
    assert got[None]["loss_chars"] == 1
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_fingerprints_choose_mappings(spark):
    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "do", "input": "", "output": "done"}, {"instruction": "do", "input": "this", "output": "done"},
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"unknown": 1}, {"question": None, "answer": "a"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, "{broken"), (8, None)]
    out = {}
    for r in sorted(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect(), key=lambda r: (r["conv_id"], r["turn"] or 0)):
        out.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert out[0] == [(0, "user", "p"), (1, "assistant", "r")]
    assert out[1] == [(0, "user", "do"), (1, "assistant", "done")] and out[2][0] == (0, "user", "do\nthis")
    assert out[3] == [(0, "user", "hi"), (1, "assistant", "ho")] and out[4] == [(0, "user", "q"), (1, "assistant", "a")]
    assert out[5] == out[7] == out[8] == [(None, None, None)] and out[6] == [(0, "user", ""), (1, "assistant", "a")]
