"""Training-order materialisation: token sequences at keyed pseudo-random global slots, in fixed-stride binary shards.

1. Documents are tokenised once and the tokens written, with the task and the place in it that they have there.
2. Documents are put in order by a hash of id and text (of repeated rows, each copy has its own); running sums of their token counts,
   taken over narrow rows, give each its place in one stream of tokens. Sequence s is the stream's s-th stretch of `length` tokens.
3. A keyed Feistel permutation with cycle-walking over 0 to N-1 gives the slot of sequence s. It depends on the rows and the key
   alone, not on files, partitions or tasks.
4. Documents are cut where sequences end. Pieces go to the shard of their slot, `per_shard` slots each, and are written in order:
   slot t is record t % per_shard of shard t // per_shard, so any slot can be sought and reading can resume anywhere.
Shard files are written under another name and moved into place, so repeated or lost tasks leave whole files.

A record: number of tokens (uint32), then `length` tokens (uint16, or uint32 for vocabularies over 65,536), padded with the end token.
Each document ends with the end token; only the last sequence is shorter.

Defined results: null and empty texts give the end token alone; repeated rows are packed each; no rows give no shards and an
empty manifest; a null id stays null in the manifest; very long texts run over many sequences; other columns are not read.
"""

from __future__ import annotations

import base64
import io
import json
import pickle
import sys
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs as arrow_fs
from pyarrow import parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, new_folder, running

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's pretokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 65_536, 20_240_601, 6
#: Rows that one bucket of a running sum holds on average, and bytes of tokens that are framed at once in a task.
BUCKET_ROWS, FRAME_BYTES = 4000, 32 << 20
#: Pieces of a frame that are held at once when it is opened.
OPENED = 500
_U = np.uint64


@dataclass
class Vocabulary:
    """Ranks file contents (small, sent to the tasks) and the end token."""

    raw: bytes
    end: int
    width: int

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            raw = f.read()
        n = raw.count(b"\n") + (not raw.endswith(b"\n"))
        return cls(raw, n, 2 if n < 1 << 16 else 4)


class Encoder:
    """Token ids as bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.raw.splitlines() if line)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kind = "H" if vocabulary.width == 2 else "I"

    def __call__(self, text: str | None) -> bytes:
        ids = array(self.kind, self.encode(text) if text else [])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One per worker process."""
    key = hash(vocabulary.raw)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1: a balanced Feistel network over the least even number of bits, repeated while outside (cycle-walking)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> _U(half), v & mask
        for r in range(rounds):
            with np.errstate(over="ignore"):
                f = b * _U(0x9E3779B97F4A7C15) + _U((key * 0x2545F4914F6CDD1D + r * 0xD1342543DE82EF95) % 2**64)
                f = (f ^ (f >> _U(29))) * _U(0xBF58476D1CE4E5B9)
                f = f ^ (f >> _U(32))
            a, b = b, a ^ (f & mask)
        return (a << _U(half)) | b

    out = once(x.astype(np.uint64))
    while len(away := np.flatnonzero(out >= _U(n))):
        out[away] = once(out[away])
    return out.astype(np.int64)


def squeeze(pieces: list[tuple]) -> bytes:
    """A frame: the pieces, pickled OPENED at a time."""
    c = zstandard.ZstdCompressor(level=3).compressobj()
    return b"".join([*(c.compress(pickle.dumps(pieces[k : k + OPENED], 5)) for k in range(0, len(pieces), OPENED)), c.flush()])


def unsqueeze(frame: bytes) -> Iterator[tuple]:
    """The pieces of a frame; no more than OPENED are held at once."""
    with zstandard.ZstdDecompressor().stream_reader(frame) as raw:
        f = io.BufferedReader(raw)
        while f.peek(1):
            yield from pickle.load(f)


def tokenised(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, pos, row_hash, doc_id, n, tokens of every document, written to the shared folder; n counts the end token, tokens lack it."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, pos = shared.value, 0
        encode, part = encoder(v), TaskContext.get().partitionId()
        for batch in batches:
            tokens = [encode(t) for t in batch["text"]]
            n = [len(t) // v.width + 1 for t in tokens]
            yield pd.DataFrame({"part": part, "pos": np.arange(pos, pos + len(batch)), "row_hash": batch["row_hash"], "doc_id": batch["doc_id"], "n": n, "tokens": tokens})
            pos += len(batch)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))).alias("row_hash"), F.col(text_col).alias("text"))
    # Ids as text, so that null ones keep the others whole.
    slim = slim.withColumn("doc_id", F.col("doc_id").cast("string"))
    return materialise(slim.mapInPandas(encoded, "part int, pos int, row_hash string, doc_id string, n bigint, tokens binary"), "tokens")


def stream_places(tokens: DataFrame, folder: str, key: int = KEY) -> int:
    """Write pos, place (tokens of the documents before) of every document under `folder`, by part; the number of all tokens."""
    total, rows = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    copy = F.row_number().over(Window.partitionBy("row_hash").orderBy("part", "pos"))
    d = tokens.select("part", "pos", "n", F.md5(F.concat_ws(":", F.lit(str(key)), "row_hash", copy)).alias("order"))
    buckets = max(1, rows // BUCKET_ROWS)
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)))
    before = running(d.groupBy("bucket").agg(F.sum("n").alias("in_bucket")), [], "bucket", "in_bucket", "before").select("bucket", "before")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = d.withColumn("inside", inside).join(before, "bucket").select("part", "pos", (F.col("before") + F.col("inside")).alias("place"))
    places.repartition("part").sortWithinPartitions("part", "pos").write.mode("overwrite").partitionBy("part").parquet(folder)
    return int(total)


def cut_pieces(tokens: DataFrame, places: str, total: int, vocabulary: Vocabulary, length: int, per_shard: int, key: int) -> DataFrame:
    """shard, frame: the documents' pieces, those of one shard and batch pressed into a frame."""
    n_slots, width = -(-total // length), vocabulary.width
    end = np.array([vocabulary.end], dtype="<u2" if width == 2 else "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _ENCODERS.clear()  # the worker may be one that has encoded; from here on none is needed
        store, root = arrow_fs.FileSystem.from_uri(places)
        held: dict[int, list] = {}
        size, part, place = 0, None, None

        def frames() -> pd.DataFrame:
            out = [(shard, squeeze(pieces)) for shard, pieces in held.items()]
            held.clear()
            return pd.DataFrame(out, columns=["shard", "frame"])

        for batch in batches:
            at = np.zeros(len(batch), np.int64)
            for i, (p, pos) in enumerate(zip(batch["part"], batch["pos"], strict=True)):
                if p != part:
                    # The places of a written part: two small numbers a document.
                    t = parquet.read_table(f"{root}/part={p}", filesystem=store, columns=["pos", "place"])
                    part, place = p, t["place"].to_numpy()[np.argsort(t["pos"].to_numpy())]
                at[i] = place[pos]
            n = np.fromiter((len(raw) // width + 1 for raw in batch["tokens"]), np.int64, len(batch))
            first, pieces = at // length, (at + n - 1) // length - at // length + 1
            own = np.cumsum(pieces) - pieces
            sequences = np.repeat(first - own, pieces) + np.arange(pieces.sum())
            slots = feistel(sequences, n_slots, key).tolist()
            for doc_id, raw, start, k, s, m in zip(batch["doc_id"], batch["tokens"], at.tolist(), own.tolist(), first.tolist(), pieces.tolist(), strict=True):
                body = raw + end
                for j in range(m):
                    a, b = max(start, (s + j) * length), (s + j + 1) * length
                    slot = slots[k + j]
                    held.setdefault(slot // per_shard, []).append((slot, a - (s + j) * length, doc_id, body[(a - start) * width : (b - start) * width]))
                size += len(raw)
                if size >= FRAME_BYTES:
                    yield frames()
                    size = 0
        if held:
            yield frames()

    return tokens.select("part", "pos", "doc_id", "tokens").mapInPandas(cut, "shard int, frame binary")


def open_frames(rows: Iterable[Row]) -> Iterator[tuple]:
    """shard, slot, start, doc_id, tokens of the pieces in rows of shard, frame; one frame at a time."""
    for shard, frame in rows:
        for piece in unsqueeze(frame):
            yield shard, *piece


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def write_shards(docs: DataFrame, folder: str | None = None, vocabulary_path: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, **columns) -> DataFrame:
    """Write the shards into `folder` (default: a new one in shared storage) and return the manifest, which is kept there too:
    slot, shard, byte_offset, n_tokens, doc_ids, starts (where each document begins in the sequence; 0: or goes on), path; one row per sequence."""
    vocabulary = Vocabulary.load(vocabulary_path)
    folder = folder or new_folder(docs.sparkSession, "shards")
    tokens = tokenised(docs, vocabulary, **columns)
    total = stream_places(tokens, f"{folder}/places", key)
    n_slots, stride = -(-total // length), 4 + length * vocabulary.width
    end = np.array([vocabulary.end], dtype="<u2" if vocabulary.width == 2 else "<u4").tobytes()
    store, root = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/layout.json") as f:
        f.write(json.dumps({"length": length, "width": vocabulary.width, "per_shard": per_shard, "sequences": n_slots}).encode())

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _ENCODERS.clear()
        store, path = arrow_fs.FileSystem.from_uri(folder)
        open_shard, stream, made = None, None, ""
        slot, raw, ids, starts, rows = None, [], [], [], []

        def close() -> None:
            if stream is not None:
                stream.close()
                store.move(made, shard_path(path, open_shard))

        def record() -> None:
            body = b"".join(raw)
            n = len(body) // vocabulary.width
            stream.write(n.to_bytes(4, "little") + body + end * (length - n))
            rows.append((slot, open_shard, n, list(ids), list(starts)))

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["slot", "shard", "n_tokens", "doc_ids", "starts"])
            rows.clear()
            return out

        for batch in batches:
            for shard, s, start, doc_id, tokens in zip(batch["shard"], batch["slot"], batch["start"], batch["doc_id"], batch["tokens"], strict=True):
                if s != slot:
                    if slot is not None:
                        record()
                    slot, raw, ids, starts = s, [], [], []
                    if shard != open_shard:
                        close()
                        open_shard, made = shard, f"{path}/.making-{uuid.uuid4().hex}"
                        stream = store.open_output_stream(made)
                raw.append(tokens)
                ids.append(None if doc_id is None else int(doc_id))
                starts.append(start)
            yield frame()
        if slot is not None:
            record()
            yield frame()
        close()

    pieces = cut_pieces(tokens, f"{folder}/places", total, vocabulary, length, per_shard, key).repartitionById(max(1, -(-n_slots // per_shard)), "shard")
    # Rows of an RDD come by their size; an Arrow batch would hold all frames of a shard at once.
    opened = docs.sparkSession.createDataFrame(pieces.rdd.mapPartitions(open_frames), "shard int, slot bigint, start int, doc_id string, tokens binary", verifySchema=False)
    ordered = opened.sortWithinPartitions("shard", "slot", "start")
    manifest = materialise(ordered.mapInPandas(write, "slot bigint, shard int, n_tokens int, doc_ids array<bigint>, starts array<int>"), "manifest", f"{folder}/manifest")
    where = F.concat(F.lit(f"{folder}/shard-"), F.lpad(F.col("shard").cast("string"), 8, "0"), F.lit(".bin"))
    return manifest.select("slot", "shard", (F.col("slot") % per_shard * stride).alias("byte_offset"), "n_tokens", "doc_ids", "starts", where.alias("path"))


def read_slots(folder: str, first: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, tokens) in order from slot `first`: a computed seek, then sequential reads; the way to resume training."""
    store, path = arrow_fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/layout.json") as f:
        layout = json.loads(f.read())
    stride, per_shard = 4 + layout["length"] * layout["width"], layout["per_shard"]
    stop = layout["sequences"] if count is None else min(layout["sequences"], first + count)
    slot = first
    while slot < stop:
        with store.open_input_file(shard_path(path, slot // per_shard)) as f:
            f.seek(slot % per_shard * stride)
            for slot in range(slot, min(stop, (slot // per_shard + 1) * per_shard)):
                record = f.read(stride)
                yield slot, np.frombuffer(record, "<u2" if layout["width"] == 2 else "<u4", int.from_bytes(record[:4], "little"), 4)
        slot += 1
