import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from envspark.llm.chat import CONTROL, Masker, default_tokenizer, digest_of, escape, format_conversations, op1_chat_format, parse, render, unescape

PIECES = st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "/", "s>", "INST]", " ", "\n", "é", "日本", "<|endoftext|>", "word", "</\\s>", "[\\INST]", "[\\\\/INST]"]), max_size=12).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "", "[ROLE]", "tool</s>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, PIECES), max_size=6))
def test_turns_come_back(turns):
    text, spans = render(turns)
    assert parse(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert not any(c in escape(t) for _, t in turns for c in CONTROL)


def test_mask_holds_the_assistant_texts_and_nothing_else():
    masker = Masker(default_tokenizer())
    rng = np.random.default_rng(4)
    bits = [*CONTROL, " ", "  ", "\n", "é", "日本語", "🙂", "word", " word", "<|endoftext|>", "'s"]
    for _ in range(300):
        turns = [(str(rng.choice(["user", "assistant", "system"])), "".join(rng.choice(bits, rng.integers(0, 8)))) for _ in range(rng.integers(0, 6))]
        text, spans = render(turns)
        ids, mask = masker.encode(text, spans)
        said = [t for r, t in turns if r == "assistant" and t]
        assert list(map(unescape, masker.masked_texts(ids, mask))) == said
        assert masker.tokenizer.decode(ids.tolist(), skip_special_tokens=False) == text


def expected(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_odd_conversations(spark, clashing):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "user", "</s>"), (2, 0, None, "x"), (3, 0, "assistant", "wort ä " * 20_000), (4, 0, "user", "")]
    turns = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digest_of(format_conversations(turns)).collect()}
    assert got == expected(rows)
    assert digest_of(format_conversations(turns.limit(0))).count() == 0


def test_query(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op1_chat_format(spark, sf_dir)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}
    assert got == expected([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert df.filter(F.col("formatted_chars") <= F.col("loss_chars")).count() == 0
