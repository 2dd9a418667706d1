"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches

RANKS = "byte_bpe_50k.tiktoken"
#: Texts longer than this are encoded in pieces of about this many characters.
PIECE = 65_536
#: Rows encoded before a batch is handed on.
STEP = 512
#: A space or line feed after a letter, digit or punctuation mark. No match of the pattern has white space after
#: another character, so one always begins here, and what precedes looks the same to it with or without what follows.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])[ \n]")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """text in pieces whose encodings, one after the other, are that of text; longer than most where no safe place comes."""
    start = 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, enc: tiktoken.Encoding) -> list[int]:
    text = text or ""
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text) for i in enc.encode_ordinary(piece)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (array of int), n_tokens, decoded (binary), in one pass without a shuffle.

    A null text is empty and has no ids. No special tokens are recognised: their strings are ordinary text. decoded is
    the bytes of the ids joined, which need not be cut at characters; for ids of a whole text they are its UTF-8.
    Repeated rows, null ids and extra columns change nothing. Ranks lie at the same path on every machine.
    """
    path, pat = ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pat)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                ids = [encode(t, enc) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())],
                    ["doc_id", "ids", "n_tokens", "decoded"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded binary")


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents with digests in place of ids and bytes: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The digests are taken where the ids are made, so ids don't cross to the JVM only to be hashed.
    """
    path, pat = ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pat)
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for cell in b.column("text"):
                ids = encode(cell.as_py(), enc)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                of_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids); null ids decode to no bytes, an unknown id is an error."""
    path, pat = ranks_path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pat)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([enc.decode_bytes(cell.as_py() or []) for cell in b.column("ids")], pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
