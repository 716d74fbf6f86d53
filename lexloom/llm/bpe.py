"""Byte-level BPE encoding and decoding with a given rank file.

Texts are dealt to chunks by what they hold. Each chunk lists its distinct pre-tokens,
which stand at known positions of its texts: the explode happens within the chunk, whose
positions needn't travel, as splitting a text again gives them again. The pre-tokens of
all chunks are shuffled by word, in packets of a chunk and a group of words, so that
every distinct word is encoded once in its group's task; its ids go back to the chunks
that hold it, where texts are reassembled by position. Decoding looks each id up in the
token-byte table: a join with a table as large as the vocabulary, which is broadcast and
held as arrays.

A pre-token's own copies are counted within its chunk, before the exchange, so a word
that all texts share costs a row a chunk. Chunks are of bounded size, partitions hold as
many chunks as there are for them, one in memory at a time; groups of words are at most
GROUPS, so that packets stay fewer than words.

Defined cases: a null or empty text has no tokens and decodes to the empty string; rows
are told apart by their place in the chunk, so repeated rows and null ids need no care;
an empty table gives an empty table;
unpaired surrogates can't occur in Spark strings. Other columns pass through, and one
named like an output column gives way to it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._common import documents, small_batches

#: Characters of text that one chunk aims at.
CHUNK_CHARS = 4 << 20
#: Groups that words are dealt to at most, a task each.
GROUPS = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_encoders: dict[int, object] = {}


def word_encoder(ranks: dict[bytes, int], name: int):
    """A function from a word's bytes to its ids' bytes: the tiktoken library with a pattern
    that takes a whole word as one piece, which gives the ids of its merges. One encoder is
    kept for each set of ranks that a worker meets."""
    import tiktoken

    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = tiktoken.Encoding(f"words-{name}", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    encode = _encoders[name].encode_ordinary
    return lambda w: np.array(encode(w.decode("utf-8")), dtype=np.int32).tobytes()


class Splitter:
    """All matches of a pattern, as the regex library finds them. In ASCII texts \\p{L} and
    \\p{N} are plain ranges, with which the standard library is three times as fast."""

    def __init__(self, pattern: str):
        import re

        import regex

        self.exact = regex.compile(pattern).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        # Other classes may differ between the libraries.
        self.fast = re.compile(plain).findall if set(re.findall(r"\\(.)", plain)) <= {"s", "S"} and "(?<" not in plain else self.exact
        self.odd = re.compile("[\x1c-\x1f]").search

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.fast(text) if text.isascii() and not self.odd(text) else self.exact(text)


def packed(parts: list[bytes]) -> bytes:
    """Byte strings as one compressed block: count, lengths, contents."""
    import zstandard

    sizes = np.array([len(p) for p in parts], dtype=np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(parts)).tobytes() + sizes.tobytes() + b"".join(parts))


def unpacked(block: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


class Numbering(dict):
    """Word -> its number in the order of appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of the rows in which, one after another."""
    n = size[which]
    ends = np.cumsum(n)
    return flat[np.repeat(start[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _squeeze(texts: list) -> list[list]:
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    return [[None if t is None else c.compress(t.encode("utf-8", "surrogatepass")) for t in texts]]


def _unsqueeze(z: bytes | None) -> str | None:
    import zstandard

    return None if z is None else zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass")


def _by_bucket(words, buckets: int) -> dict[int, list[bytes]]:
    """A chunk's distinct words, dealt by hash and sorted, which both its passes repeat."""
    import zlib

    out: dict[int, list[bytes]] = {}
    for w in words:
        b = w.encode("utf-8", "surrogatepass")
        out.setdefault(zlib.crc32(b) % buckets, []).append(b)
    for v in out.values():
        v.sort()
    return out


#: Characters of texts in a partition at most, on average.
PART_CHARS = 256 << 20
#: Encoded words that a task keeps; beyond it a word may be encoded once more.
KEPT_WORDS = 400_000
PACKETS = "_lexloom_chunk int, _bucket int, _packet binary"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """docs with ids (array of int) and n_tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    from lexloom.llm._common import add_columns, column_of, parallel

    spark = docs.sparkSession
    small_batches(spark)
    id_col, text_col = column_of(docs, id_col), column_of(docs, text_col)
    docs = docs.drop("ids", "n_tokens")
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    # Partitions follow the data where the session's number would make them large.
    parts = max(parallel(spark), -(-chars // PART_CHARS))
    buckets, chunks = min(parts, GROUPS), max(parts, -(-chars // chunk_chars))
    held, name = spark.sparkContext.broadcast(ranks), hash(frozenset(ranks.items()))
    chunk = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).cast("int")
    # Texts travel compressed.
    dealt = add_columns(docs.withColumn("_lexloom_chunk", chunk), [text_col], _squeeze, {"_lexloom_text": "binary"}, without=(text_col,)).repartition(parts, "_lexloom_chunk")

    def packets(c: int, seen: set) -> Iterator[pa.RecordBatch]:
        for k, v in _by_bucket(seen, buckets).items():
            yield pa.RecordBatch.from_pydict({"_lexloom_chunk": pa.array([c], pa.int32()), "_bucket": pa.array([k], pa.int32()), "_packet": pa.array([packed(v)], pa.binary())})

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, now, seen = Splitter(pattern), None, set()
        for b in batches:
            for c, z in zip(b.column("_lexloom_chunk").to_pylist(), b.column("_lexloom_text").to_pylist(), strict=True):
                if c != now:
                    yield from packets(now, seen)
                    now, seen = c, set()
                seen.update(find(_unsqueeze(z)))
        yield from packets(now, seen)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        one = word_encoder(held.value, name)
        for b in batches:
            out = []
            for block in b.column("_packet").to_pylist():
                ids = []
                for w in unpacked(block):
                    x = known.get(w)
                    if x is None:
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        x = known[w] = one(w)
                    ids.append(x)
                out.append(packed(ids))
            yield pa.RecordBatch.from_arrays([b.column("_lexloom_chunk"), b.column("_bucket"), pa.array(out, pa.binary())], names=["_lexloom_chunk", "_bucket", "_packet"])

    names = [c for c in docs.columns]
    schema = StructType(docs.schema.fields + [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        find = Splitter(pattern)
        texts = [_unsqueeze(z) for z in left.column("_lexloom_text").to_pylist()]
        own = Numbering()
        at = [np.fromiter(map(own.__getitem__, find(t)), dtype=np.int32) for t in texts]
        by_bucket, parts, order = _by_bucket(own, buckets), [], []
        for k, block in zip(right.column("_bucket").to_pylist(), right.column("_packet").to_pylist(), strict=True):
            parts += unpacked(block)
            order += [own[w.decode("utf-8", "surrogatepass")] for w in by_bucket[k]]
        # Ids of the chunk's words one after another, and where each word's begin.
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        size = np.array([len(x) // 4 for x in parts], dtype=np.int64)
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(parts), dtype=np.int32)
        ids = [ragged(flat, start, size, place[x]) for x in at]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
        target = to_arrow_schema(schema)
        old = [pa.array(texts, target.field(c).type) if c == text_col else left.column(c) for c in names]
        old += [pa.ListArray.from_arrays(offsets, values), pa.array(sizes, pa.int64())]
        return pa.table([x.cast(f.type) if x.type != f.type else x for x, f in zip(old, target, strict=True)], names=names + ["ids", "n_tokens"])

    ids = dealt.sortWithinPartitions("_lexloom_chunk").mapInArrow(words, PACKETS).repartition(buckets, "_bucket").mapInArrow(encoded, PACKETS)
    return dealt.groupBy("_lexloom_chunk").cogroup(ids.groupBy("_lexloom_chunk")).applyInArrow(placed, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], *, ids_col: str = "ids") -> DataFrame:
    """encoded with ``decoded`` (binary): the bytes of its ids. The token-byte table is
    joined where the ids lie; it is broadcast, being as large as the vocabulary."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    encoded = encoded.drop("decoded")
    token = {i: b for b, i in ranks.items()}
    size = np.zeros(max(token, default=0) + 1, dtype=np.int64)
    for i, b in token.items():
        size[i] = len(b)
    held = encoded.sparkSession.sparkContext.broadcast((size, b"".join(token[i] for i in sorted(token))))
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, raw = held.value
        start, flat = np.cumsum(size) - size, np.frombuffer(raw, dtype=np.uint8)
        target = to_arrow_schema(schema)
        for b in batches:
            out = []
            ids = b.column(b.schema.get_field_index(ids_col))
            for k in range(len(ids)):
                x = ids[k].values
                out.append(ragged(flat, start, size, np.asarray(x)).tobytes() if x is not None else b"")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, target.field("decoded").type)], names=[*b.schema.names, "decoded"])

    small_batches(encoded.sparkSession)
    return encoded.mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = decode(encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
