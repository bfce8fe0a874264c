import hashlib
import random
import re

import numpy as np

from larkspur.llm.chat_format import assemble, encode_rows, escape, read_back, render, unescape
from larkspur.llm.queries import HOSTILE

from .conftest import words

SCHEMA = "conv_id long, turn long, role string, text string"


def test_escaping():
    r = random.Random(7)
    for _ in range(2000):
        t = "".join(r.choice("<|\\> a") for _ in range(r.randint(0, 12)))
        assert "<|" not in escape(t) and unescape(escape(t)) == t
    assert len({escape(a + b + c + d) for a in "<|\\" for b in "<|\\" for c in "<|\\" for d in "<|\\"}) == 81


def test_mask_is_a_prefix_sum():
    turns = [(np.array([1, 2]), np.array([3]), False), (np.array([4]), np.array([5, 6, 7]), True), (np.array([4]), np.array([], int), True)]
    ids, mask = assemble(turns, 100)
    assert ids.tolist() == [100, 1, 2, 101, 3, 102, 100, 4, 101, 5, 6, 7, 102, 100, 4, 101, 102]
    assert ids[mask].tolist() == [5, 6, 7]


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((-(1 << 62) if turn is None else turn, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_round_trip(spark):
    r = random.Random(8)
    rows = [(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE), (5, None, None, None), (5, 1, "assistant", ""), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (None, 0, "a\nb", "<\\|x|>"), (6, 0, "assistant", "y" * 30000)]
    for c in range(10, 40):
        for turn in range(r.randint(1, 8)):
            text = "".join(w + r.choice([" ", "\n", "  ", "<|", "<|im_end|>", "<|endoftext|>", "é日"]) for w in words(r, r.randint(0, 20)))
            rows.append((c, turn, r.choice(["user", "assistant", "system"]), text))
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "mine", 1) for x in rows], SCHEMA + ", piece string, loss_begin int")
    encoded = encode_rows(df)
    got = {x.conv_id: x for x in read_back(encoded).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for c, x in got.items():
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == want[c], c
    # The rendered string has as many characters as told, and only the template's own control strings.
    for x in render(encoded).collect():
        assert len(x.formatted) == got[x.conv_id].formatted_chars
        assert len(re.findall(r"<\|im_start\|>", x.formatted)) == got[x.conv_id].n_turns == len(re.findall(r"<\|im_end\|>", x.formatted))


def test_empty(spark):
    assert read_back(encode_rows(spark.createDataFrame([], SCHEMA))).count() == 0
