"""Document fingerprints from content-defined chunks.

A gear hash runs over the UTF-8 bytes: each byte's random 32-bit number is added to the hash
shifted left by one, so it depends on the last 32 bytes alone. A chunk ends where masked bits of
the hash are zero; the mask is strict up to the normal size and loose beyond it (normalised
chunking), with a least and a largest size. Boundaries follow the content, so an edit
moves only the chunks around it. A fingerprint is the set of the chunks' digests, each
weighted by its length; containment is the weight of the shared digests over that of
the document's own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindscape.session import cut_lineage

SEED = 42
LEAST, NORMAL, LARGEST = 16, 48, 256
STRICT_BITS, LOOSE_BITS = 6, 4
PIECE = 4 << 20


def gear_table(seed: int = SEED) -> np.ndarray:
    """256 random 32-bit numbers, derived from the seed."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed) for b in range(256)], dtype=np.uint32)


_GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: sum of gear[byte j back] << j over 32 bytes, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            step = np.zeros_like(h)
            step[k:] = h[:-k] << np.uint32(k)
            h = h + step
    return h


def _candidates(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) at which the strict and the loose mask are zero; in pieces of bounded size."""
    strict, loose = [], []
    s_mask = np.uint32(((1 << STRICT_BITS) - 1) << (32 - STRICT_BITS))
    l_mask = np.uint32(((1 << LOOSE_BITS) - 1) << (32 - LOOSE_BITS))
    for at in range(0, len(data), PIECE):
        back = min(at, 31)
        h = gear_hashes(data[at - back:at + PIECE])[back:]
        low = np.flatnonzero((h & l_mask) == 0)
        loose.append(low + at + 1)
        strict.append(low[(h[low] & s_mask) == 0] + at + 1)
    return (np.concatenate(strict), np.concatenate(loose)) if strict else (np.empty(0, np.int64),) * 2


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a byte string (the last is its length; none if it is empty)."""
    n = len(data)
    if n == 0:
        return []
    strict, loose = (c.tolist() for c in _candidates(np.frombuffer(data, np.uint8)))
    strict.append(n + LARGEST)
    loose.append(n + LARGEST)
    ends, start, i, j = [], 0, 0, 0
    while n - start > LEAST:
        while strict[i] < start + LEAST:
            i += 1
        end = strict[i]
        if end > start + NORMAL:
            while loose[j] <= start + NORMAL:
                j += 1
            end = min(loose[j], start + LARGEST)
        if end >= n:
            break
        ends.append(end)
        start = end
    ends.append(n)
    return ends


def chunk_set(text: str | None) -> dict[int, int]:
    """Digest -> length of the distinct chunks of a text."""
    data = (text or "").encode("utf-8")
    out, start, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in chunk_ends(data):
        out[digest(data[start:end])] = end - start
        start = end
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's weight that b holds, 0 to 1; an empty set is contained in an empty one alone."""
    if not a:
        return 0.0 if b else 1.0
    return sum(w for d, w in a.items() if d in b) / sum(a.values())


def set_digest(chunks: dict[int, int]) -> str:
    """Hex digest of a chunk set (of its sorted digests and lengths)."""
    keys = sorted(chunks)
    body = np.array([keys, [chunks[k] for k in keys]], dtype="<u8").tobytes()
    return hashlib.blake2b(body, digest_size=16).hexdigest()


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ordinal, start, length, digest)`` per chunk, offsets in UTF-8 bytes. Null and empty texts
    have none; repeated rows repeat."""

    @F.arrow_udf("array<struct<start:bigint,length:int,digest:bigint>>")
    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            data, start, row = (t.as_py() or "").encode("utf-8"), 0, []
            for end in chunk_ends(data):
                d = xxhash.xxh3_64_intdigest(data[start:end])
                row.append({"start": start, "length": end - start, "digest": d - (1 << 64) if d >> 63 else d})
                start = end
            rows.append(row)
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()),
                                                  ("digest", pa.int64())])))

    cuts = docs.select(F.col(id_col).alias("id"), F.posexplode(cut(F.col(text_col))).alias("ordinal", "c"))
    return cuts.select(F.col("id").alias(id_col), "ordinal", "c.start", "c.length", "c.digest")


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first characters of
    ``following`` (or all of it)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(text: str, following: str, own: dict[int, int], other: dict[int, int]) -> tuple:
    changed = edited(text, following)
    new = own if changed == text else chunk_set(changed)
    return (len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), set_digest(own), set_digest(new),
            containment(own, new), containment(own, other))


RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``
    against the next row in descending order of id (nulls last; ties by text; after the last: the first).

    A null text is empty. An empty text has the empty fingerprint, alike only to an empty one. A
    single row is its own next. Repeated rows follow each other. Other columns are ignored.

    Rows are range-partitioned once by id and the text's beginning. A task compares each row with the next
    one it reads; its first and last row are kept with their texts (two rows per partition), and
    the last row of each partition is compared with the first of the next one that has rows."""
    ids = F.col(id_col).cast("long")
    rows = docs.select(ids.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.col("text").asc()]

    def walk(batches):
        from pyspark import TaskContext
        part, first, held, out = TaskContext.get().partitionId(), None, None, []

        def batch_of(found):
            kinds, ids_, texts, results = zip(*found, strict=True)
            cols = [pa.array(kinds, pa.int32()), pa.array([part] * len(found), pa.int32()),
                    pa.array(ids_, pa.int64()), pa.array(texts, pa.string())]
            cols += [pa.array(c, t) for c, t in zip(zip(*results, strict=True), _TYPES, strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

        none = (None,) * 6
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                row = (i.as_py(), t.as_py())
                chunks = chunk_set(row[1])
                if held is not None:
                    (i0, t0), c0 = held
                    out.append((0, i0, None, _compare(t0, row[1], c0, chunks)))
                    if len(out) >= 4096:
                        yield batch_of(out)
                        out = []
                else:
                    first = row
                held = (row, chunks)
        if held is not None:
            out += [(1, *first, none), (2, *held[0], none)]
            yield batch_of(out)

    schema = "kind int, part int, id long, text string, " + RESULT
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of (id, beginning of the text) follow the order too, and part rows of one id
    begins = F.substring("text", 1, 32).asc()
    seen = cut_lineage(rows.repartitionByRange(parts, order[0], begins).sortWithinPartitions(*order).mapInArrow(walk, schema))

    # two rows per partition: the numbers of the partitions that have rows, in order
    used = [r[0] for r in seen.where("kind = 1").select("part").orderBy("part").collect()]
    after = docs.sparkSession.createDataFrame(
        [(p, used[(k + 1) % len(used)]) for k, p in enumerate(used)], "part int, next_part int")
    heads = seen.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = seen.where("kind = 2").select("part", "id", "text").join(after, "part").join(heads, "next_part")

    @F.arrow_udf("struct<" + ", ".join(x.replace(" ", ":", 1) for x in RESULT.replace("long", "bigint").split(", ")) + ">")
    def across(texts: pa.Array, nexts: pa.Array) -> pa.Array:
        found = [_compare(t.as_py(), n.as_py(), chunk_set(t.as_py()), chunk_set(n.as_py()))
                 for t, n in zip(texts, nexts, strict=True)]
        cols = list(zip(*found, strict=True)) or [()] * 6
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)],
                                          [x.split()[0] for x in RESULT.split(", ")])

    names = [x.split()[0] for x in RESULT.split(", ")]
    last = tails.select("id", across("text", "next_text").alias("r")).select("id", "r.*")
    return seen.where("kind = 0").select("id", *names).union(last.select("id", *names)).withColumnRenamed("id", id_col)
