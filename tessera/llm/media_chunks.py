"""Media columns with content-defined chunking and a deduplicated chunk store.

A text's bytes, padded to whole units, are a payload of 8-bit samples. A rolling
gear hash cuts the payload where its bytes say so; equal stretches of different
payloads therefore give equal chunks. The stored form of a payload is its ordered
chunk list (length and digest of each) and its distinct chunks.

In the corpus a chunk is stored once: digests are counted, chunks that occur once
stay with their document, and the data of every digest that occurs more often goes
to a store, one row per digest. Reading back joins the chunk lists with the store
and rebuilds each stored form in order; chunk digests and the whole payload's
digest are verified. The texts are read twice, to count and to store; a document
without shared chunks meets no join.

The set of shared digests is given to the tasks as one array of 16 bytes each while
there are at most ``broadcast_digests``; beyond that every chunk goes through the
store and its join.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, checkpointed, join_spread

UNIT = 192
PAD = b" "
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 256, 11, 16_384
MAGIC = b"CDC1"
#: One 32-bit number per byte value: the gear table, derived from a hash so that it needs no listing.
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], dtype=np.uint32)


class MediaError(ValueError):
    """Stored media that are incomplete or do not match their digests."""


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes padded to a positive multiple of UNIT, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (-len(raw) % UNIT if raw else UNIT), len(raw)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks. The gear hash of a place, sum of gear[byte] << age, has the last 32 bytes in it."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[step:] = h[:-step]
        h = h + (older << np.uint32(step))
    places = np.nonzero(h >> np.uint32(32 - MASK_BITS) == 0)[0] + 1
    ends, start = [], 0
    for place in places.tolist():
        while place - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if place - start >= MIN_CHUNK:
            ends.append(place)
            start = place
    while len(data) - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    if start < len(data):
        ends.append(len(data))
    return ends


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks_of(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, chunk) in order."""
    start, out = 0, []
    for end in cut_points(payload):
        chunk = payload[start:end]
        out.append((digest_of(chunk), chunk))
        start = end
    return out


def store_media(chunks: list[tuple[bytes, bytes]]) -> bytes:
    """The stored form: magic, number of chunks, (length, digest) of each, distinct chunks in order of appearance."""
    head = [MAGIC, struct.pack("<I", len(chunks))]
    head += [struct.pack("<I", len(c)) + d for d, c in chunks]
    return b"".join(head + list(dict(chunks).values()))


def load_media(media: bytes) -> bytes:
    """The payload of a stored form, each chunk verified."""
    if media[:4] != MAGIC:
        raise MediaError("not a stored form")
    (n,) = struct.unpack_from("<I", media, 4)
    at, seen, out = 8 + 20 * n, {}, []
    for i in range(n):
        (length,) = struct.unpack_from("<I", media, 8 + 20 * i)
        digest = media[12 + 20 * i : 28 + 20 * i]
        if digest not in seen:
            seen[digest] = media[at : at + length]
            at += length
            if len(seen[digest]) != length or digest_of(seen[digest]) != digest:
                raise MediaError("a chunk does not match its digest")
        out.append(seen[digest])
    if at != len(media):
        raise MediaError("the stored form has a rest")
    return b"".join(out)


def feature_of(payload: bytes) -> str:
    """Samples' mean, standard deviation and steps: integers of thousandths and a count."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    n, total, square = len(x), int(x.sum()), int((x * x).sum())
    crossings = int(np.count_nonzero((x[1:] * n > total) != (x[:-1] * n > total)))
    return f"mean={total * 1000 // n};var={(square * n - total * total) * 1000 // (n * n)};crossings={crossings}"


def describe(media: bytes) -> tuple[int, str, int, int, str, str]:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, of the payload read back."""
    payload = load_media(media)
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))


# ------------------------------------------------------------------------ Spark
_FIELDS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_TYPES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(texts: DataFrame) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"digest": [d for t in pdf["text"] for d, _ in chunks_of(payload_of(t)[0])]})

    return texts.select("text").mapInPandas(of, "digest binary")


def _stored(docs: DataFrame, shared: Callable[[], frozenset | None]) -> DataFrame:
    """All that one reading of the texts gives, told apart by ``kind``.

    doc: a document's id, size and fields if all of its chunks are its own, else the
    key of its payload. part: a place of a chunk list (key, idx, digest), with the data
    of a chunk of the document's own. chunk: a shared digest with its data. Parts and
    chunks come once a task.
    """
    columns = ["kind", "doc_id", "n_bytes", "key", "idx", "digest", "data", *_FIELDS]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, listed, sent = shared(), set(), set()
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                payload, n = payload_of(text)
                chunks = chunks_of(payload)
                if known is not None and not any(d in known for d, _ in chunks):
                    out.append(("doc", doc, n, None, None, None, None, *describe(store_media(chunks))))
                    continue
                key = hashlib.sha256(payload).hexdigest()
                out.append(("doc", doc, n, key, *(None,) * 9))
                if key in listed:
                    continue
                listed.add(key)
                for i, (d, c) in enumerate(chunks):
                    own = known is not None and d not in known
                    out.append(("part", None, None, key, i, d, zlib.compress(c, 6) if own else None, *(None,) * 6))
                    if not own and d not in sent:
                        sent.add(d)
                        out.append(("chunk", None, None, None, None, d, zlib.compress(c, 6), *(None,) * 6))
            frame = pd.DataFrame(out, columns=columns)
            for c in ("doc_id", "n_bytes", "idx", "payload_bytes", "tail_crc32", "media_bytes"):
                frame[c] = pd.array(frame[c], dtype="Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, f"kind string, doc_id long, n_bytes long, key string, idx long, digest binary, data binary, {_TYPES}")


def _rebuilt(pieces: DataFrame) -> DataFrame:
    """Sorted pieces (key, idx, data) to one row of fields per key; the stored form is rebuilt, read and verified."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunks, done = None, [], []

        def close() -> None:
            fields = describe(store_media(chunks))
            if fields[1] != key:
                raise MediaError(f"payload {key} is not what its chunks give")
            done.append((key, *fields))

        for pdf in batches:
            for k, idx, digest, data in zip(pdf["key"], pdf["idx"], pdf["digest"], pdf["data"], strict=True):
                if k != key:
                    if key is not None:
                        close()
                    key, chunks = k, []
                if idx != len(chunks):
                    raise MediaError(f"payload {k} has no chunk {len(chunks)}")
                chunks.append((bytes(digest), zlib.decompress(data)))
            if done:
                yield pd.DataFrame(done, columns=["key", *_FIELDS])
                done = []
        if key is not None:
            close()
            yield pd.DataFrame(done, columns=["key", *_FIELDS])

    return pieces.mapInPandas(of, f"key string, {_TYPES}")


def media_column(docs: DataFrame, broadcast_digests: int = 1_000_000) -> DataFrame:
    """Store and read back every text of ``docs(doc_id, text, ...)``: doc_id, n_bytes and the fields of ``describe``.

    Null texts count as empty and give one unit of padding. Equal texts give equal
    values and are rebuilt once; repeated rows and null ids stay. A missing or
    damaged chunk fails the job.
    """
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    several = _digests(docs).groupBy("digest").count().filter("count > 1").select("digest")
    head = several.limit(broadcast_digests + 1).collect()
    if len(head) <= broadcast_digests:
        array = spark.sparkContext.broadcast(b"".join(bytes(r[0]) for r in head))

        def shared() -> frozenset | None:
            return frozenset(array.value[i : i + 16] for i in range(0, len(array.value), 16))
    else:

        def shared() -> frozenset | None:
            return None

    stored = checkpointed(_stored(docs, shared))
    rows, parts, chunks = (stored.filter(F.col("kind") == kind) for kind in ("doc", "part", "chunk"))
    store = chunks.groupBy("digest").agg(F.first("data").alias("data"))
    listed = parts.filter("data is null").select("key", "idx", "digest").distinct()
    read = listed.join(store, "digest").select("key", "idx", "digest", "data")
    own = parts.filter("data is not null").select("key", "idx", "digest", "data")
    rebuilt = _rebuilt(read.union(own).repartition("key").sortWithinPartitions("key", "idx"))
    whole = rows.filter("key is null").select("doc_id", "n_bytes", *_FIELDS)
    shared_rows = checkpointed(rows.filter("key is not null").select("doc_id", "n_bytes", "key"))
    joined = join_spread(shared_rows, rebuilt, "key")
    missing = F.when(F.col("payload_bytes").isNull(), F.raise_error(F.concat(F.lit("no chunks of payload "), "key"))).otherwise(F.col("n_bytes"))
    return whole.union(joined.select("doc_id", missing.cast("long").alias("n_bytes"), *_FIELDS))
