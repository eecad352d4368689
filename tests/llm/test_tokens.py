"""Token counts against the vocabulary's own library."""

import random

import pytest

from hopwise.llm import tokens

P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "Hello  world\n\n x", "<|endoftext|> a<|endoftext|>", "it's 12 345 é ö ß 中文  x  ", "a" * 30_000, ("word, other " * 4000), ("ab \n" * 9000), " " * 20_000 + "x"]


def library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_byte_level_counts(docs):
    path = P.path("byte_bpe_50k.json")
    rows = {r["doc_id"]: r for r in tokens.token_counts(docs(*enumerate(TEXTS)), path).collect()}
    wanted = library("byte_bpe_50k.json", TEXTS)
    for k, text in enumerate(TEXTS):
        assert (rows[k]["n_bytes"], rows[k]["n_tokens"], rows[k]["over_limit"]) == (len((text or "").encode()), wanted[k], wanted[k] > 1024)


def test_pieces_add_up_to_the_text():
    rng = random.Random(9)
    counter, cut = tokens.load_counter(open(P.path("byte_bpe_50k.json"), "rb").read())
    assert cut
    for _ in range(60):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "'s", "7", "é", ".", "Zu", "<|endoftext|>"]) for _ in range(400))
        parts = tokens.pieces(text, 37)
        assert "".join(parts) == text and len(parts) > 1
        assert sum(counter(parts)) == counter([text])[0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    data = open(P.path(name), "rb").read()
    counter, cut = tokens.load_counter(data, name.rpartition(".")[2])
    texts = ["Hello world", "", "a  b c"]
    assert not cut
    if name.endswith(".json"):
        assert counter(texts) == library(name, texts)
    else:
        import sentencepiece

        assert counter(texts) == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts)]


def test_edges(docs, empty):
    path = P.path("byte_bpe_50k.json")
    data = docs((None, "x"), (1, "x"), (1, "x")).withColumnRenamed("n_chars", "n_tokens")
    assert [r["n_tokens"] for r in tokens.token_counts(data, path).collect()] == [1, 1, 1]
    assert tokens.token_counts(empty, path).count() == 0
