"""Byte-level BPE with the tiktoken library and a rank file: whole texts to ids, and ids to bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: A text longer than this is encoded in parts of about this many characters.
PART = 50_000
#: White space this long goes to the merges as one piece, since the library's regex engine backs up over it.
LONG_BLANK = 2_000
#: What the pattern's \s matches: Unicode's White_Space, which in Python's own \s has four more characters.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = re.compile(f"[{WHITE}]{{{LONG_BLANK},}}")
#: A pattern that takes a text as one piece.
WHOLE = r"[\s\S]+"
#: No match of the pattern goes on from a character that isn't white space into white space, and none looks
#: ahead from there: white space stands at the start of a match or makes up all of it.
SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


@lru_cache(maxsize=8)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file, without special tokens; one for each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """Cuts of ``text`` that no match of the pattern crosses; true with those that are one match of white space."""
    begin = 0
    for blank in [*BLANKS.finditer(text), None]:
        # A run before more text gives up its last character, which the pattern leaves to the next match.
        start = blank.start() if blank else len(text)
        while start - begin > size:
            cut = SAFE.search(text, begin + size, start)
            if not cut:
                break
            yield text[begin : cut.start()], False
            begin = cut.start()
        if start > begin:
            yield text[begin:start], False
        if blank:
            begin = blank.end() if blank.end() == len(text) else blank.end() - 1
            yield text[start:begin], True


def encode(path: str, text: str) -> list[int]:
    """The ids of a whole text, as ``encode_ordinary`` would give them."""
    if len(text) <= LONG_BLANK:
        return encoding(path).encode_ordinary(text)
    ids: list[int] = []
    for part, one in parts(text):
        ids += (encoding(path, WHOLE) if one else encoding(path)).encode_ordinary(part)
    return ids


def decode(path: str, ids: list[int]) -> bytes:
    """The bytes of ids, which needn't be UTF-8 where ids were cut from a text."""
    return encoding(path).decode_bytes(ids)


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """For each row: id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256 of the ids' bytes.

    A null text is empty: no ids, the digests of nothing. Rows stand alone: repeated rows and
    identifiers, null or not, give a row each. Other columns play no part. ``path`` is a rank file at the same
    place on every machine, or the name of one sent with ``SparkContext.addFile``.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, {'ids array<int>, ' if ids else ''}ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = path if "/" in path else SparkFiles.get(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                got = encode(ranks, text.as_py() or "")
                rows.append((len(got), got, sha(" ".join(map(str, got)).encode()), sha(decode(ranks, got))))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            out = {"id": batch.column(0), "n_tokens": pa.array(cols[0], pa.int64())}
            if ids:
                out["ids"] = pa.array(cols[1], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out | {"ids_sha256": pa.array(cols[2], pa.string()), "decoded_sha256": pa.array(cols[3], pa.string())})

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
