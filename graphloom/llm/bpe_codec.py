"""Byte-level BPE encoding and decoding (6) with the tiktoken library and a local rank file.

Long texts are cut before encoding at boundaries that no match of the splitting pattern can
cross: in front of a single space between two characters that are no white space. Decoding
works on raw bytes, so ids that end inside a character are no special case.

Defined results: null text is the empty text; rows stay apart even if repeated; ids of an empty
text are the empty list; nothing is cut off from very long texts; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from graphloom.llm.common import small_batches

#: Texts of more characters are split before they are encoded.
LONG = 65_536
SAFE = re.compile(r"(?<=\S)(?= \S)")


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def rank_encoding(rank_file: str | None = None, pattern: str | None = None):
    """tiktoken Encoding of a rank file; the multilingual 50k file by default."""
    import public_tokenizers
    import tiktoken

    with open(rank_file or _public("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def json_encoder(tokenizer_file: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids by the vocabulary of a byte-level tokenizer file of the tokenizers library.

    tiktoken runs the merges, four times as fast; the tests hold the ids against tokenizers.
    """
    import public_tokenizers
    import tiktoken

    with open(tokenizer_file or _public("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    # The file writes a byte as a printable character: itself, or the next one from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    encoding = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        return [i for part in split_safely(text) for i in encoding.encode(part, allowed_special="all")]

    return encode


def split_safely(text: str, size: int = LONG) -> list[str]:
    """Parts of about `size` characters, cut only where no pattern match can cross."""
    parts, at = [], 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        parts.append(text[at : cut.start()])
        at = cut.start()
    parts.append(text[at:])
    return parts


def encode(text: str, rank_file: str | None = None) -> list[int]:
    encoding = rank_encoding(rank_file)
    return [i for part in split_safely(text) for i in encoding.encode_ordinary(part)]


def decode_bytes(ids: list[int], rank_file: str | None = None) -> bytes:
    return rank_encoding(rank_file).decode_bytes(ids)


def encode_documents(docs: DataFrame, rank_file: str | None = None) -> DataFrame:
    """doc_id, ids of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "ids": [encode(t or "", rank_file) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str | None = None) -> DataFrame:
    """doc_id, bytes of every list of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "bytes": [decode_bytes([int(i) for i in ids], rank_file) for ids in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str | None = None) -> DataFrame:
    """Encode, decode and digest in one pass: ids and decoded bytes stay in the task."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, a, d = [], [], []
            for text in b["text"]:
                ids = encode(text or "", rank_file)
                n.append(len(ids))
                a.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(decode_bytes(ids, rank_file)).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_tokens": np.array(n, dtype="int64"), "ids_sha256": a, "decoded_sha256": d})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
