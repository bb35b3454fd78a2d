"""Exact round trips of formatted conversations."""

import hashlib
import random

import numpy as np

from quillon.llm import chat_format as c


def test_escape_is_reversible():
    r = random.Random(2)
    for _ in range(2000):
        t = "".join(r.choice("<|\\>ab") for _ in range(r.randint(0, 12)))
        assert c.unescape(c.escape(t)) == t and "<|" not in c.escape(t)


def test_token_mask_against_overlap():
    r = random.Random(3)
    for _ in range(500):
        cuts = sorted(r.sample(range(60), r.randint(2, 20)))
        starts, stops = np.array(cuts[:-1]), np.array(cuts[1:])
        points = sorted(r.sample(range(61), 2 * r.randint(0, 5)))
        spans = list(zip(points[::2], points[1::2], strict=True))
        want = [any(a < q and p < b for p, q in spans) for a, b in zip(starts, stops, strict=True)]
        assert c.token_mask(starts, stops, spans).tolist() == want


def rows():
    r = random.Random(4)
    bits = ["<|im_end|>", "<|im_start|>", "a b", " ", "\n", "é€😀", "assistant", "<\\|", "word", "", "\x00", "  x"]
    out = []
    for conv in range(40):
        for turn in range(r.randint(1, 9)):
            out.append((conv, turn, r.choice(["user", "assistant", "system", None, "<|x|>"]), r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))]), "z"))
    return out + [(7, 0, "assistant", "again", "z"), (None, 0, "assistant", "no id", "z"), (90, 0, "assistant", "long " * 30000, "z"), (90, 1, "assistant", "end", "z")]


def test_digests_against_the_turns(spark):
    data = rows()
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, part string").repartition(5)
    for part_chars in (c.PART_CHARS, 20):
        got = {r.conv_id: r for r in c.digests(c.format_conversations(df, part_chars=part_chars)).collect()}
        assert set(got) == {r[0] for r in data}
        for conv, g in got.items():
            turns = sorted(((t, role or "", text or "") for i, t, role, text, _ in data if i == conv))
            spoken = "".join(t for _, role, t in turns if role == "assistant")
            assert g.n_turns == len(turns)
            assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
            assert (g.loss_chars, g.loss_sha256) == (len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
            assert g.formatted_chars == len(c.render([(r, t) for _, r, t in turns])[0])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.digests(c.format_conversations(empty)).count() == 0
