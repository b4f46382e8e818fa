import os
import random

import pytest
import tiktoken

from stepwright.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.DEFAULT_RANKS), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def ranks():
    return encode.read_ranks(encode.DEFAULT_RANKS)


def test_equals_a_tokenizer_on_made_up_texts(ranks):
    own = tiktoken.Encoding("own", pat_str=encode.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    parts = ["the", " token", "izer's", "\n\n ", "  x", "été", "测试", "🧪", "1234", "__a_b__", " ", "​", "<|endoftext|>", "aaaa", "ab" * 40, "ﬀ", "\x00"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(1, 40))) for _ in range(400)] + ["a" * 5000, " " * 300, "", None]
    got = encode.TrieEncoder(ranks, memo_entries=500).encode_texts(texts)
    assert got == [own.encode_ordinary(t) if t else [] for t in texts]
    assert all(own.decode(g) == (t or "") for g, t in zip(got, texts, strict=True))


def test_every_row_once_with_clashing_columns(spark, ranks):
    rows = [(1, "a b", 5), (1, "a b", 5), (2, None, 5), (3, "", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in encode.encode(df, "doc_id", "text").collect()), key=repr)
    ab = encode.TrieEncoder(ranks).encode_texts(["a b"])[0]
    assert [g for g in got if g[0] is not None] == [(1, ab), (1, ab), (2, []), (3, [])] and len(got) == 5
    assert encode.encode(df.limit(0), "doc_id", "text").count() == 0
