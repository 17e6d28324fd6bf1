"""SimHash near-duplicates joined through the anchors of a covering code.

Fingerprint: 64 bits over word shingles (see ``fingerprint_bits``).

Join: the 64 bits hold two 31-bit pieces A and B and two spare bits. If two
fingerprints differ in at most four bits, they differ in at most two bits of A
or in at most one bit of B (three in A leave one). On each piece the anchors
are the codewords of the perfect [31, 26] Hamming code: every piece value is
within radius 1 of exactly one codeword. One copy of a fingerprint goes to the
anchor that covers it, and it is replicated to every anchor within radius 1
plus the piece's threshold (156 anchors for A, 15.5 on average for B). Two
close fingerprints therefore meet at the anchor that covers the smaller one; there
all 64 bits are compared. The join is exact: the code only decides where
fingerprints meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindscape.llm.components import connected_components, spanning_links
from bindscape.session import cut_lineage

SHINGLE = 4
MAX_BITS = 4
PIECE_BITS = 31
PIECE_MASK = (1 << PIECE_BITS) - 1
#: (shift of the piece in the fingerprint, differing bits allowed in it)
PIECES = ((0, 2), (31, 1))
BLOCK = 1 << 16
SALTS = 16
ROW_SALTS = 8


def fingerprint_bits(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text: A-Z lower-cased, words are runs of
    anything but ASCII white space, shingles are ``shingle`` words joined by a
    space with repeats counted; a shorter text is one shingle, no words give 0. A
    bit is set if more than half of the shingle hashes (XXH64, seed 42) have it."""
    import xxhash
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total, n, digest = np.zeros(64, np.int64), len(words) - shingle + 1, xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        j = min(n, i + BLOCK)
        h = np.array([digest(joined[s:e], 42) for s, e in
                      zip(starts[i:j].tolist(), ends[i + shingle - 1:j + shingle - 1].tolist(), strict=True)],
                     dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a signed long (the 64 bits of ``fingerprint_bits``)."""

    @F.arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        bits = np.fromiter((fingerprint_bits(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(bits.view(np.int64))

    return compute(text)


def codeword_offsets() -> list[tuple[int, int, list[int]]]:
    """``(threshold, syndrome, masks)``: the codewords within radius 1 + threshold of a
    31-bit value are its covering codeword XOR each mask. Derived from the code: a
    word is a codeword if the XOR of its set positions (1 to 31) is zero."""
    bit = [0] + [1 << i for i in range(PIECE_BITS)]
    three = [(i, j, i ^ j) for i in range(1, 32) for j in range(i + 1, 32) if (i ^ j) > j]
    four = [(i, j, k, i ^ j ^ k) for i in range(1, 32) for j in range(i + 1, 32)
            for k in range(j + 1, 32) if (i ^ j ^ k) > k]
    words = [()] + three + four
    out = []
    for t in sorted({t for _, t in PIECES}):
        for s in range(32):
            # a value with syndrome s is its covering codeword with position s flipped
            near = [w for w in words if len(w) + (0 if s == 0 else 1 - 2 * (s in w)) <= 1 + t]
            out.append((t, s, [sum(bit[p] for p in w) for w in near]))
    return out


def _syndrome(piece: Column) -> Column:
    """XOR of the 1-based positions of the set bits (five parity checks)."""
    s = F.lit(0)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1)
        s = s + (F.bit_count(piece.bitwiseAND(F.lit(mask))) % 2) * (1 << j)
    return s


def _pieces(fps: DataFrame) -> DataFrame:
    """``(fp, part, threshold, syndrome, home)`` for each piece of each fingerprint."""
    parts = F.explode(F.array(*[
        F.struct(F.lit(k).alias("part"), F.lit(t).alias("threshold"),
                 F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(PIECE_MASK)).alias("piece"))
        for k, (shift, t) in enumerate(PIECES)]))
    p = fps.select("fp", parts.alias("p")).select("fp", "p.*").withColumn("syndrome", _syndrome(F.col("piece")))
    flip = F.when(F.col("syndrome") == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("syndrome") - 1).cast("int")))
    return p.withColumn("home", F.col("piece").bitwiseXOR(flip))


def close_pairs(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of the distinct fingerprints in ``fps.fp`` that differ in
    at most ``max_bits`` (at most 4) bits, each once."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the anchors cover at most {MAX_BITS} differing bits")
    spark: SparkSession = fps.sparkSession
    # each row becomes 172: dealt out over all partitions, which a small input would not fill by itself
    pieces = _pieces(fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp"))
    masks = spark.createDataFrame(codeword_offsets(), "threshold int, syndrome int, masks array<long>")
    key = (F.col("home") * 2 + F.col("part")).alias("anchor")
    covered = pieces.select(key, F.col("fp").alias("a"))
    # 64 rows of masks, fixed by the code: a broadcast of proven size
    spread = (pieces.join(F.broadcast(masks), ["threshold", "syndrome"])
              .select("fp", "part", "home", F.explode("masks").alias("mask"))
              .select((F.col("home").bitwiseXOR(F.col("mask")) * 2 + F.col("part")).alias("anchor"),
                      F.col("fp").alias("b")))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    first_piece = F.bit_count(diff.bitwiseAND(F.lit(PIECE_MASK)))
    # reported on piece A if A differs in at most its threshold, else on piece B
    once = (F.col("c.anchor") % 2 == 0) == (first_piece <= PIECES[0][1])
    near = (F.bit_count(diff) <= max_bits) & (F.col("a") < F.col("b")) & once
    return (covered.hint("shuffle_hash").alias("c")
            .join(spread.alias("s"), (F.col("c.anchor") == F.col("s.anchor")) & near).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``(id, fingerprint, component_id)``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest id
    reachable through links of at most ``max_bits`` differing bits (itself included).

    Null, empty and blank texts have fingerprint 0 and form one group like any other.
    Repeated rows give repeated results. A row with a null id takes part and is
    never the representative; a group without any id has a null component. Other
    columns are ignored. An empty table gives an empty result."""
    fps = cut_lineage(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), shingle).alias("fp")))
    groups = cut_lineage(fps.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(spanning_links(close_pairs(groups.select("fp"), max_bits), "a", "b"))
    # most fingerprints have no partner; of a large component, members and its one row meet in SALTS tasks
    members = cut_lineage(roots.join(groups, roots["node"] == groups["fp"]).select("fp", "root", "first"))
    low = members.groupBy("root").agg(F.min("first").alias("low"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    named = members.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(
        low.select("root", "low", every), ["root", "salt"]).select(F.col("fp").alias("member"), "low")
    classes = groups.join(named, groups["fp"] == named["member"], "left").select(
        "fp", F.when(F.col("member").isNull(), F.col("first")).otherwise(F.col("low")).alias("component_id"))
    # rows of one fingerprint (all empty texts, say) meet its class in ROW_SALTS tasks
    each = F.explode(F.sequence(F.lit(0), F.lit(ROW_SALTS - 1))).alias("salt")
    rows = fps.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(ROW_SALTS)).cast("int"))
    return rows.join(classes.select("*", each), ["fp", "salt"]).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the row with the smallest id
    (ties: the smallest text). Rows with a null id, or whose group has no id, stay."""
    cols = docs.columns
    found = cut_lineage(near_duplicates(docs, id_col, text_col, shingle, max_bits)
                        .where(F.col(id_col).isNotNull())
                        .groupBy(F.col(id_col).alias("__id"))
                        .agg(F.min("component_id").alias("__first"), F.count(F.lit(1)).alias("__n")))
    drop = found.where(F.col("__first") < F.col("__id")).select("__id")
    kept = docs.join(drop, docs[id_col] == drop["__id"], "left_anti")
    twice = found.where((F.col("__first") == F.col("__id")) & (F.col("__n") > 1)).select("__id")
    if twice.isEmpty():
        return kept
    # ids that occur in several rows: the least row of each, combined before the shuffle
    single = kept.join(twice, kept[id_col] == twice["__id"], "left_anti")
    again = kept.join(twice, kept[id_col] == twice["__id"], "left_semi")
    rest = [c for c in cols if c not in (id_col, text_col)]
    least = again.groupBy(F.col(id_col).alias("__id")).agg(
        F.min(F.struct(F.col(text_col), *[F.col(c) for c in rest])).alias("__r"))
    return single.unionByName(least.select(
        *[F.col("__id").alias(c) if c == id_col else F.col(f"__r.{c}").alias(c) for c in cols]))
