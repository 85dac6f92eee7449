"""Token counts against whole texts encoded one at a time."""

import random

import public_tokenizers
import pytest

from parlance.llm import token_counts as tc

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"]


def plain(name):
    """The library's own call on one whole text."""
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda t: len(model.encode(t, add_special_tokens=False).ids)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    model = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(model.encode_ordinary(t))


def odd_text(seed, n):
    rng = random.Random(seed)
    bits = ["word", "Wörter", "it's", "we'll", "123", "4.5", "...", "<|endoftext|>", "<|start", "日本語", "ÀÉ", "é", "\U0001f600", "-", "'s", "▁", "</s>"]
    gaps = ["", " ", " ", " ", "  ", "\n", "\n\n", " \n", "\t", " ", "　", "\r\n", "\x1c", " "]
    return "".join(rng.choice(bits) + rng.choice(gaps) for _ in range(n))


@pytest.mark.parametrize("name", FILES)
def test_pieces_add_up(name):
    kind = "." + name.rsplit(".", 1)[1]
    count = plain(name)
    for seed in range(40):
        text = odd_text(seed, 400)
        parts = tc.pieces(text, kind, 50)
        assert len(parts) > 5
        assert sum(map(count, parts)) == count(text), seed
    assert tc.pieces("a" * 500, kind, 50) == ["a" * 500]


@pytest.mark.parametrize("name", FILES)
def test_against_whole_texts(spark, documents, name):
    long = odd_text(7, 60_000)
    rows = [(1, "Hello world, it's 42!"), (2, None), (3, ""), (3, ""), (3, "two rows of one id"), (None, "no id"), (5, " \n "), (6, "<|endoftext|> inside<|endoftext|>")]
    rows += [(7, long), (8, "x" * 70_000), (9, odd_text(3, 50))]
    count = plain(name)
    want = sorted(((i, len((t or "").encode()), count(t or ""), count(t or "") > 9) for i, t in rows), key=repr)
    got = tc.token_counts(documents(rows), public_tokenizers.path(name), limit=9)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_whole_table(spark, sf_dir):
    count = plain("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.op13_token_counts(spark, sf_dir).collect()}
    assert got == {d["doc_id"]: (len((d["text"] or "").encode()), count(d["text"] or ""), count(d["text"] or "") > 1024) for d in docs}


def test_empty_table_and_names(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tc.token_counts(documents([]), path).count() == 0
    odd = spark.createDataFrame([("a", "x y", 5)], "`n.tokens` string, `the.text` string, n_tokens int")
    assert [tuple(r) for r in tc.token_counts(odd, path, id_col="n.tokens", text_col="the.text").collect()] == [("a", 3, 2, False)]
    with pytest.raises(ValueError, match="no tokenizer"):
        tc._encoder(".bin", b"")
