import base64
from pathlib import Path

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import tokens

RAW = Path(tokens.RANKS).read_bytes()
BPE = tokens.Bpe(RAW)
PUBLIC = tiktoken.Encoding(
    "own",
    pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())},
    special_tokens={},
)


def split(flat, n):
    at, out = 0, []
    for k in n.tolist():
        out.append(flat[at : at + k].tolist())
        at += k
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("ab '\n　é", max_size=300), max_size=6))
def test_equals_public_encoder(texts):
    assert split(*BPE.encode(texts)) == [PUBLIC.encode_ordinary(t) for t in texts]


def test_long_words_and_specials():
    texts = ["a" * 3000, "ab" * 900 + "x" * 77, " " * 500 + "x", "<|endoftext|>", "－" * 150, "1234567890" * 30, "a\x1c b", None, ""]
    assert split(*BPE.encode(texts)) == [PUBLIC.encode_ordinary(t or "") for t in texts]


def test_operator(spark):
    rows = [(1, "Hello world", 5), (2, None, 5), (3, "", 5), (4, "é 你好" * 500, 5), (1, "Hello world", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = sorted([(r.doc_id or 0, r.ids) for r in tokens.encode_texts(df).collect()])
    assert out == sorted([(i or 0, PUBLIC.encode_ordinary(t or "")) for i, t, _ in rows])
    assert tokens.encode_texts(df.limit(0)).count() == 0
