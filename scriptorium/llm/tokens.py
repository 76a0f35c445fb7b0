"""Sizes of texts in tokens of a public byte-level tokenizer (no training, no file copied here)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# ---- fixed value: how the public vocabulary splits a text before merging bytes ----
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ---- end of fixed value ----


@lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY):  # noqa: ANN201
    """The tokenizer of a vocabulary file of `base64 rank` lines; loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, digest) of `docs(doc_id, text, source)`; texts without tokens, null texts and null ids are left out. The digest names the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = [len(encode(t)) if t.strip() else 0 for t in texts]
            digests = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "source", "tokens", "digest"])

    own = docs.where("doc_id is not null and text is not null").select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    return own.mapInArrow(run, "doc_id bigint, source string, tokens bigint, digest binary").where("tokens > 0")
