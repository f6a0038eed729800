"""Sizes of texts in tokens of a public byte-level BPE, exact and without encoding the same word twice."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every function here.
TOKENIZERS = os.environ.get("FOLIOSCOPE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer cuts text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A token never spans a single space between two words, so a text may be sized stretch by stretch.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_CACHE: dict[str, int] = {}
_ENCODING: dict[str, object] = {}


def encoding(path: str):
    if path not in _ENCODING:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODING[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODING[path]


def size_of(text: str, path: str) -> int:
    """Number of tokens of a text, the same as of encoding it whole."""
    enc = encoding(path)
    total = 0
    for i, piece in enumerate(_CUT.split(text)):
        key = " " + piece if i else piece
        n = _CACHE.get(key)
        if n is None:
            n = len(enc.encode_ordinary(key))
            if len(key) < 40:
                if len(_CACHE) > 400_000:
                    _CACHE.clear()
                _CACHE[key] = n
        total += n
    return total


def sizes(documents: DataFrame, keep: list[str] | None = None, text: str = "text", path: str | None = None) -> DataFrame:
    """(keep…, tokens long): one row a row of documents; NULL and empty texts have 0 tokens."""
    where = path or f"{TOKENIZERS}/{VOCABULARY}"
    keep = keep or ["doc_id"]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            n = [size_of(t, where) if t else 0 for t in pdf["__t"]]
            yield pdf.drop(columns="__t").assign(tokens=n)

    rows = documents.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(run, schema + ", tokens long")
