"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts up to ``long_chars`` are encoded where they are read: no shuffle. Longer ones are cut into overlapping chunks
that are pre-tokenised in parallel. A chunk starts at an arbitrary place, so its first boundaries may be wrong; where a
boundary of it coincides with a proved one of the chunk before, both agree from there on, because a match of the pattern
depends only on the text from its start. Chunks are stitched at the first such place; where the overlap has none (a run of one
character, say) the chunks stay together as one piece. Pieces are encoded in parallel and joined per document.

Null and empty texts have an empty list. Decoding concatenates the raw bytes of the tokens.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from treeloom.runtime import materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_CHARS = 32_768
CHUNK = 16_384
OVERLAP = 1_024

_LOADED: dict[str, object] = {}


def tokenizer_file(spark: SparkSession) -> str:
    """Place of the vocabulary on every machine; the session setting ``spark.treeloom.tokenizers`` overrides it."""
    return os.path.join(spark.conf.get("spark.treeloom.tokenizers", TOKENIZERS), VOCABULARY)


def load(path: str):
    """The encoder, loaded once in each Python worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("treeloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def _pattern():
    if "pattern" not in _LOADED:
        import regex

        _LOADED["pattern"] = regex.compile(PATTERN)
    return _LOADED["pattern"]


def decode(ids: list[int], path: str) -> str:
    """Text of token ids: the tokens' bytes, concatenated, then read as UTF-8."""
    enc = load(path)
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8", "replace")


def _space(c: str) -> bool:
    if "space" not in _LOADED:
        import regex

        _LOADED["space"] = regex.compile(r"\s")
    return _LOADED["space"].match(c) is not None


def boundaries(text: str, start: int, end: int) -> list[int]:
    """Places in ``text`` where a match begins, from its start on, with ``start <= place <= end``.

    Matches that reach the end of ``text`` may go on beyond it; their ends are not given.
    """
    found, n = [], len(text)
    for m in _pattern().finditer(text):
        at = m.start()
        if at > end:
            break
        if at >= start:
            found.append(at)
        if m.end() == n:
            break
    return found


def _cut(chunk: int, overlap: int, kind: pa.DataType):
    """Chunks of each text under an id of their own: keys may be null or come twice. A restarted task makes new ids, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, uid = max(1, -(-len(text) // chunk)), uuid.uuid4().hex
                for i in range(n):
                    part = text[i * chunk : (i + 1) * chunk + (overlap if i + 1 < n else 0)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid]), pa.array([doc], kind), pa.array([i], pa.int32()), pa.array([i + 1 == n]), pa.array([part])], names=["uid", "doc", "i", "last", "part"]
                    )

    return run


def _presplit(chunk: int, overlap: int):
    """Boundaries of each chunk in the two zones it shares with its neighbours, as offsets from the zone's start.

    ``sure`` is the first one in the zone with the chunk before that holds whatever comes before the chunk: no match has
    white space after anything else, so there is a boundary before white space that follows another character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right, sure = [], [], []
            for last, part in zip(b.column("last").to_pylist(), b.column("part").to_pylist(), strict=True):
                # A piece must not end in white space: what a run of it matches depends on what follows.
                cuts = [x for x in boundaries(part, 0, chunk + overlap) if x == 0 or not _space(part[x - 1])]
                left.append([x for x in cuts if x <= overlap])
                sure.append(next((x for x in left[-1] if 0 < x and _space(part[x])), None))
                right.append([] if last else [x - chunk for x in cuts if x >= chunk])
            yield pa.RecordBatch.from_arrays(
                [b.column("uid"), b.column("i"), b.column("last"), pa.array(left, pa.list_(pa.int32())), pa.array(right, pa.list_(pa.int32())), pa.array(sure, pa.int32())], names=["uid", "i", "last", "head", "tail", "sure"]
            )

    return run


def _ids(path: str, count_only: bool):
    """Encode the second column; the others are passed on. Null is like empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            arrays = [enc.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in texts]
            sizes = np.fromiter((len(a) for a in arrays), np.int32, len(arrays))
            if count_only:
                out = pa.array(sizes.astype(np.int64), pa.int64())
            else:
                offsets = np.zeros(len(arrays) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), out, *(b.column(i) for i in range(2, b.num_columns))], names=["doc", "ids", *b.schema.names[2:]])

    return run


def _pieces(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc, text, uid, piece): the long texts, cut only at boundaries of pre-tokens; uid is one for each row of ``long``."""
    kind = long.select("doc").schema[0].dataType
    cut = long.mapInArrow(_cut(chunk, overlap, to_arrow_type(kind)), f"uid string, doc {kind.simpleString()}, i int, last boolean, part string")
    chunks = materialize(cut.repartition("uid", "i"), "chunks")  # stored: the ids are made once, the texts are read and cut once
    zones = materialize(chunks.mapInArrow(_presplit(chunk, overlap), "uid string, i int, last boolean, head array<int>, tail array<int>, sure int"), "zones")
    before = zones.filter("not last").select("uid", (F.col("i") + 1).alias("i"), "tail")
    common = F.array_min(F.array_intersect("head", "tail"))
    met = zones.select("uid", "i", "head", "sure").join(before, ["uid", "i"], "left").select("uid", "i", F.when(F.col("i") == 0, F.lit(0)).otherwise(common).alias("met"), "sure")
    w = Window.partitionBy("uid").orderBy("i")  # one small row per chunk, no text
    # A chunk that does not meet the one before has unproved boundaries, and so have those after it that only meet each
    # other, up to a boundary that is sure by itself.
    lost = F.coalesce(F.max(F.when(F.col("met").isNull(), F.col("i"))).over(w), F.lit(-1))
    found = F.coalesce(F.max(F.when(F.col("sure").isNotNull(), F.col("i"))).over(w), F.lit(-1))
    proved = met.select("uid", "i", "met", "sure", (lost < 0) | (found >= lost)).toDF("uid", "i", "met", "sure", "proved")
    follows = F.lag("proved", 1, True).over(w) & F.col("met").isNotNull()
    sync = proved.select("uid", "i", F.when(F.col("proved"), F.when(follows, F.col("met")).otherwise(F.col("sure"))).alias("sync"))
    sync = sync.select(
        "uid", "i", F.coalesce("sync", F.lit(0)).alias("from"), F.coalesce(F.lead("sync").over(w), F.lit(0)).alias("more"),
        F.last(F.when(F.col("sync").isNotNull(), F.col("i")), True).over(w).alias("piece"),
    )
    own = F.when(F.col("last"), F.expr("substring(part, `from` + 1)")).otherwise(F.expr(f"substring(part, `from` + 1, {chunk} + more - `from`)"))
    parts = chunks.join(sync, ["uid", "i"]).select("uid", "doc", "piece", F.struct("i", own.alias("t")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["t"]), "")
    return parts.groupBy("uid", "piece").agg(F.first("doc").alias("doc"), joined.alias("text")).select("doc", "text", "uid", "piece")


def encode(
    docs: DataFrame, key: str, text: str, path: str, count_only: bool = False,
    long_chars: int = LONG_CHARS, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(doc, ids) of every row: ids a list of ints, or with ``count_only`` their number (long).

    ``key`` may be of any simple type, null or repeated: each row gives one row. ``long_chars`` only says which way a
    text takes; both give the same ids.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    of_key, kind = dict(rows.dtypes)["doc"], "long" if count_only else "array<int>"
    short = rows.filter(~is_long).mapInArrow(_ids(path, count_only), f"doc {of_key}, ids {kind}")
    pieces = _pieces(rows.filter(is_long), chunk, overlap).mapInArrow(_ids(path, count_only), f"doc {of_key}, ids {kind}, uid string, piece int")
    if count_only:
        whole = F.sum("ids")
    else:
        whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]))
    return short.unionAll(pieces.groupBy("uid").agg(F.first("doc").alias("doc"), whole.alias("ids")).select("doc", "ids"))
