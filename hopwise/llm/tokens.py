"""Token counts: batch encoding in an Arrow function that returns lengths only.

The file of a byte-level BPE vocabulary is read once on the driver and sent to the workers as one
broadcast of its fixed size. Texts are cut into pieces at places where no token can cross, the pieces
are packed into batches of about equal UTF-8 bytes, each one call of the library, and only three numbers per text
come back.

Defined cases: a null text counts as the empty text (0 bytes, 0 tokens); a very long text is cut where no
token can cross and its pieces' counts are added up; null and repeated ids, and repeated rows, pass
through row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import ready_for_python, slices

#: Characters of a piece before a cut is looked for, and bytes of a batch.
PIECE_CHARS = 16_384
BATCH_BYTES = 1 << 20

_encoders: dict = {}


def byte_of() -> dict[str, int]:
    """Byte-level BPE shows each byte as a printable character: itself if it is one, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes by rank, if the file is plain byte-level BPE whose ids follow its merges; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", False)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )
    if not plain:
        return None
    ids, added = model["vocab"], {t["content"] for t in spec["added_tokens"]}
    made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or len(set(made)) + 256 != len(ids.keys() - added):
        return None
    back = byte_of()
    return {bytes(back[c] for c in token): i for token, i in ids.items() if token not in added}


#: Fixed value: how byte-level BPE splits a text before merging.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_counter(data: bytes, kind: str = "json"):
    """A function from texts to their numbers of tokens, for a vocabulary file; and whether texts may be cut.

    A plain byte-level BPE runs in the faster library with the same ranks; any other .json, and .model,
    run in the library the file is made for, on uncut texts. Special strings inside a text become their
    special token, as is those libraries' default.
    """
    if kind == "model":
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        return (lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]), False
    spec = json.loads(data)
    ranks = _ranks(spec)
    if ranks is not None:
        import tiktoken

        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        encoding = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=special)
        return (lambda texts: [len(x) for x in encoding.encode_batch(texts, num_threads=1, allowed_special="all")]), True
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return (lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]), False


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text, cut before single spaces between two characters that aren't white space.

    A byte-level token takes at most one space, at its start, and such a space starts one; so the
    pieces' tokens are the text's. A text without such a place stays whole.
    """
    out, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while 0 <= at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0 or at >= len(text) - 1:
            break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


def count_all(texts: list[str | None], counter, cut: bool = True, batch_bytes: int = BATCH_BYTES) -> tuple[list[int], list[int]]:
    """UTF-8 bytes and tokens of each text."""
    n_bytes = [0] * len(texts)
    n_tokens = [0] * len(texts)
    batch: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        for owner, n in zip(owners, counter(batch), strict=True):
            n_tokens[owner] += n
        batch.clear()
        owners.clear()

    for k, text in enumerate(texts):
        if not text:
            continue
        n_bytes[k] = len(text.encode("utf-8"))
        for piece in pieces(text) if cut else [text]:
            batch.append(piece)
            owners.append(k)
            held += len(piece) if piece.isascii() else len(piece.encode("utf-8"))
            if held >= batch_bytes:
                flush()
                held = 0
    flush()
    return n_bytes, n_tokens


def token_counts(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > max_tokens) for every row of docs."""
    spark = docs.sparkSession
    ready_for_python(spark)
    with open(tokenizer_file, "rb") as file:
        data = file.read()
    shared = spark.sparkContext.broadcast(data)
    digest, kind = hashlib.sha256(data).hexdigest(), tokenizer_file.rpartition(".")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _encoders:
            _encoders[digest] = load_counter(shared.value, kind)
        for batch in slices(batches):
            n_bytes, n_tokens = count_all(batch.column(1).to_pylist(), *_encoders[digest])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > max_tokens for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
