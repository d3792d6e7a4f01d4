import random

import pytest

from papyrion.llm.tokens import ForcedBoundaryBPE, default_path, default_pattern, encode_documents

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def bpe():
    return ForcedBoundaryBPE(open(default_path(), "rb").read(), default_pattern())


@pytest.fixture(scope="module")
def reference(bpe):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=bpe.ranks, special_tokens={})


def encode(bpe, t):
    out = []
    bpe.encode(t, out)
    return out


def test_same_ids_as_a_plain_encoder(bpe, reference):
    assert bpe.blank_cuts
    rng = random.Random(0)
    alphabet = list(" \n\t  a1'sé漢.,-😀\r  ") + ["  ", "the", " 's", "<|endoftext|>", "à ", "Việt "]
    for _ in range(4000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert encode(bpe, s) == reference.encode_ordinary(s), repr(s)


def test_forced_cuts_lie_in_no_token(bpe):
    for t in bpe.ranks:
        assert all(bpe.inside[a << 8 | b] for a, b in zip(t, t[1:]))


def test_very_long_pieces(bpe, reference):
    for s in ("ab" * 50_000, "漢" * 20_000, " " * 30_000, "x y " * 30_000):
        assert encode(bpe, s) == reference.encode_ordinary(s)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "   ", "x"), (4, "Hello world", "x"), (4, "Hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_documents(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and len(got[2][1]) > 0
    assert got[3] == got[4] == (4, [15496, 995])
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
