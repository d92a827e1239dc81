"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is split by the tokenizer's pattern and every match is encoded by itself. Matches not seen
lately are padded into matrices by length; in each round every row merges its leftmost pair of least
rank, found by a vectorised hash lookup, and rows and columns are compacted. A match that is a token
as it stands is that token. Matches above LONG_PIECE bytes, for which rounds of one merge would be
quadratic, take the same merges from a heap.

Token ids travel as packed little-endian unsigned 32-bit integers in a binary column. The vocabulary
is of fixed size and broadcast. Results for odd rows: null and empty texts have no tokens and decode
to empty bytes; rows that repeat a doc_id are encoded each; an empty table gives an empty result;
columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import heapq
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LONG_PIECE = 1024
#: Encoded matches that a task remembers; when full it starts afresh.
REMEMBERED = 200_000
#: Texts of about so many characters together are encoded at once; of a longer one so many matches.
CHUNK_CHARS, LONG_MATCHES = 1 << 19, 1 << 16
NONE = np.int32(2**31 - 1)


def default_vocabulary() -> tuple[str, str]:
    """(path of the ranks, split pattern)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Vocabulary:
    """Token bytes by id and a hash table from pairs of ids to the id they merge to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        if [r for _, r in tokens] != list(range(len(tokens))) or len(tokens) >= 1 << 16:
            raise ValueError("ranks must run from 0 and stay below 65536")
        self.lengths = np.array([len(t) for t, _ in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(t for t, _ in tokens), dtype=np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in tokens:
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 16 | b] = rank
        self.pairs = pairs
        self._build(np.fromiter(pairs, dtype=np.uint64, count=len(pairs)), np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs)))

    def bytes_of_ids(self) -> dict:
        """What decoding needs."""
        return {k: getattr(self, k) for k in ("lengths", "starts", "flat")}

    @classmethod
    def of(cls, fields: dict) -> Vocabulary:
        """The vocabulary with these fields, as broadcast."""
        out = cls.__new__(cls)
        out.__dict__.update(fields)
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.shift = np.uint64(64 - bits)
        self.table_keys = np.full((1 << bits) + 64, np.uint64(2**64 - 1), dtype=np.uint64)
        self.table_values = np.full(len(self.table_keys), NONE, dtype=np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # each free slot takes the first key that wants it, the others move on
            free = self.table_keys[slot[left]] == np.uint64(2**64 - 1)
            wanted, first = np.unique(slot[left][free], return_index=True)
            placed = left[free][first]
            self.table_keys[wanted], self.table_values[wanted] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] += 1
            self.probes += 1

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Per pair the id it merges to, NONE if it doesn't; ids below 0 are padding."""
        keys = (a.astype(np.int64) << 16 | b.astype(np.int64)).astype(np.uint64)
        slot = self._slot(keys)
        at = self.table_keys[slot]
        out = np.where(at == keys, self.table_values[slot], NONE)
        todo = np.flatnonzero((at != keys) & (at != np.uint64(2**64 - 1)) & (a >= 0) & (b >= 0))
        for step in range(1, self.probes):
            if not len(todo):
                break
            at = self.table_keys[slot[todo] + step]
            hit = at == keys[todo]
            out[todo[hit]] = self.table_values[slot[todo[hit]] + step]
            todo = todo[~hit & (at != np.uint64(2**64 - 1))]
        out[(a < 0) | (b < 0)] = NONE
        return out


def _encode_long(vocab: Vocabulary, piece: bytes) -> bytes:
    ids = vocab.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    pairs = vocab.pairs
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := pairs.get(ids[i] << 16 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else len(ids)
            if left >= 0 and right < len(ids) and (r := pairs.get(ids[left] << 16 | ids[right])) is not None:
                heapq.heappush(heap, (r, left, ids[left], ids[right]))
    return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()


def _encode_bucket(vocab: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    lengths = np.array([len(p) for p in pieces])
    width = int(lengths.max())
    ids = np.full((len(pieces), width), -1, dtype=np.int32)
    inside = np.arange(width)[None, :] < lengths[:, None]
    ids[inside] = vocab.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    rank = vocab.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
    row = np.arange(len(pieces))
    out = [b""] * len(pieces)
    while len(row):
        live = np.zeros(len(row), dtype=bool)
        if rank.shape[1]:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            live = best != NONE
        if not live.all():
            done = ids[~live]
            kept = done >= 0
            packed, ends = done[kept].astype("<u4").tobytes(), (np.cumsum(kept.sum(axis=1)) * 4).tolist()
            for k, begin, end in zip(row[~live].tolist(), [0, *ends], ends):
                out[k] = packed[begin:end]
        if not live.any():
            break
        ids, rank, row, at, best = ids[live], rank[live], row[live], at[live], best[live]
        n, lanes = np.arange(len(row)), np.arange(ids.shape[1] - 1)[None, :]
        ids[n, at] = best
        ids = np.take_along_axis(ids, lanes + (lanes > at[:, None]), axis=1)
        lanes = lanes[:, :-1]
        rank = np.take_along_axis(rank, lanes + (lanes >= at[:, None]), axis=1)
        if rank.shape[1]:
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = vocab.merged(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < rank.shape[1])
            rank[right, at[right]] = vocab.merged(ids[right, at[right]], ids[right, at[right] + 1])
    return out


def encode_pieces(vocab: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Packed token ids of each match."""
    out = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        whole = vocab.ranks.get(piece)
        if whole is not None:
            out[k] = whole.to_bytes(4, "little")
        elif len(piece) > LONG_PIECE:
            out[k] = _encode_long(vocab, piece)
        else:
            size = len(piece)
            buckets.setdefault((size + 3) // 4 if size <= 32 else 8 + size.bit_length(), []).append(k)
    for members in buckets.values():
        widest = max(len(pieces[k]) for k in members)
        step = max(1, (1 << 19) // widest)
        for i in range(0, len(members), step):
            part = members[i : i + step]
            for k, ids in zip(part, _encode_bucket(vocab, [pieces[k] for k in part])):
                out[k] = ids
    return out


def _encoder(vocab, pattern: str):
    def run(batches):
        import pyarrow as pa
        import regex

        split, v, known = regex.compile(pattern), Vocabulary.of(vocab.value), {}

        def learn(matches: set) -> None:
            new = [p for p in matches if p not in known]
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(matches)
            for p, ids in zip(new, encode_pieces(v, [p.encode() for p in new])):
                known[p] = ids

        def long_text(text: str) -> bytes:
            found, packed = (m.group() for m in split.finditer(text)), []
            while part := list(itertools.islice(found, LONG_MATCHES)):
                learn(set(part))
                packed.append(b"".join(map(known.__getitem__, part)))
            return b"".join(packed)

        for batch in batches:
            column = batch.column("text")
            packed, row = [], 0
            while row < len(column):
                chunk, chars = [], 0
                while row < len(column) and chars < CHUNK_CHARS:
                    text = column[row].as_py() or ""
                    if len(text) > CHUNK_CHARS:
                        if not chunk:
                            packed.append(long_text(text))
                            row += 1
                        break
                    chars += len(text)
                    chunk.append(split.findall(text))
                    row += 1
                learn({p for pieces in chunk for p in pieces})
                packed += [b"".join(map(known.__getitem__, pieces)) for pieces in chunk]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def decode_ids(vocab: Vocabulary, packed: bytes) -> bytes:
    ids = np.frombuffer(packed, dtype="<u4")
    parts = []
    for k in range(0, len(ids), 1 << 18):
        part = ids[k : k + (1 << 18)]
        width = vocab.lengths[part]
        shift = vocab.starts[part] - (np.cumsum(width) - width)
        parts.append(vocab.flat[np.repeat(shift, width) + np.arange(width.sum())].tobytes())
    return b"".join(parts)


def _decoder(vocab):
    def run(batches):
        import pyarrow as pa

        v = Vocabulary.of(vocab.value)
        for batch in batches:
            ids = batch.column("ids")
            decoded = [decode_ids(v, x.as_py() or b"") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), ids, pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


class Tokenizer:
    """encode() and decode() over DataFrames for one vocabulary file."""

    def __init__(self, spark, path: str | None = None, pattern: str | None = None):
        default_path, default_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
        self.pattern = pattern or default_pattern
        small_batches(spark)
        vocabulary = Vocabulary(path or default_path)
        self.vocab = spark.sparkContext.broadcast(vars(vocabulary))
        self.bytes_of_ids = spark.sparkContext.broadcast(vocabulary.bytes_of_ids())

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_tokens, ids) of every document; ids are packed integers."""
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return docs.mapInArrow(_encoder(self.vocab, self.pattern), "doc_id long, n_tokens long, ids binary")

    def decode(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` with the bytes that the ids stand for."""
        tokens = tokens.select("doc_id", "n_tokens", "ids")
        return tokens.mapInArrow(_decoder(self.bytes_of_ids), "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the packed ids and of what they decode to."""
    tokenizer = Tokenizer(docs.sparkSession, path, pattern)
    decoded = tokenizer.decode(tokenizer.encode(docs))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
