"""Exact near-duplicate line removal as a set-similarity join.

A line is the set of its words. Words are ordered by rarity, the rarest first: each word
becomes a code whose high bits are the class of its hash bucket by the number of words
counted there over all lines (a table of fixed size), so common words sort last in every
line alike. Two lines of Jaccard similarity t or more must share a word among their first
ones; that prefix, a length filter, a positional filter and a bound on the overlap from 128-bit
parity bitmaps of the sets choose the candidates, whose sets are then compared in full. Equal sets are one class, represented by the earliest line.

Only whether an earlier similar line exists is asked. So each set first meets the earliest set, and those just before
it, with two equal words among their rarest three; two sets that both have their answer from there do not meet
again in the join. Near copies of one line then cost about in proportion to their number.

Words are counted and coded in Arrow batches (numpy); joins, filters and the removal are DataFrame operations.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindscape.session import shared_dir

THRESHOLD = 0.8
BUCKET_BITS = 24
BUCKETS = 1 << BUCKET_BITS
#: Class of a bucket that holds one word of all texts: no other line can have it.
ONCE = 3
#: Parity map of a set, in words of 64 bits: two sets differ in at least as many words as their maps in bits. A
#: long line fills a map of few bits, which then tells nothing.
MAPS = ["bits", "bits_2"]
#: Hashes of two of the rarest three words of a line that occur elsewhere.
MARKS = ["mark", "mark_2", "mark_3"]
#: Sets just before one that it meets, beside the earliest.
BEFORE = 2
MAP_BITS = 26
#: Bytes of text that are coded at a time (a longer text is coded alone).
CHUNK_BYTES = 8 << 20
#: A table of removed lines up to this many bytes is broadcast, a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (smaller than a checkpoint)."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/lines-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PLACES = 64
#: A random number for each byte at each of the first places of a word.
_BYTES = _mixed(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _MIX)


def _chunks(batch: pa.RecordBatch, column: int):
    """``(from, rows)`` of pieces of a batch with about CHUNK_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= CHUNK_BYTES or i + 1 == len(sizes):
            yield first, batch.slice(first, i + 1 - first)
            first, held = i + 1, 0


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(row, number, line)`` of the lines of the texts that are not null."""
    cut = pc.split_pattern(texts, "\n")
    row = pc.list_parent_indices(cut).to_numpy()
    first = np.flatnonzero(np.diff(row, prepend=-1))
    number = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row, number, pc.list_flatten(cut)


def _words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lines: ``(line of each word, number of each word, hash of each number)``. Words are in lower case,
    between ASCII white space."""
    words = pc.ascii_split_whitespace(pc.utf8_lower(lines))
    line, flat = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words)
    some = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(some, min_count=0).as_py():
        line, flat = line[some.to_numpy(zero_copy_only=False)], flat.filter(some)
    coded = flat.dictionary_encode()
    return line, coded.indices.to_numpy(), word_hashes(coded.dictionary)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of non-empty words: the sum of a random number per byte and place; long words by XXH3."""
    if not len(words):
        return np.empty(0, np.uint64)
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    out = np.add.reduceat(_BYTES[(place & (PLACES - 1)) << 8 | data], starts)
    for k in np.flatnonzero(sizes > PLACES).tolist():
        out[k] = xxhash.xxh3_64_intdigest(words[k].as_py())
    return out


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """By hash bucket (a table of fixed size): the class of the number of words in the
    bucket over all lines, three classes to a doubling, so that a lower one is rarer."""

    def count(batches):
        seen = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for _, rows in _chunks(batch, 0):
                _, ids, hashes = _words(_lines(rows.column(0))[2])
                np.add.at(seen, _bucket(hashes), np.bincount(ids, minlength=len(hashes)).astype(np.uint32))
        some = np.flatnonzero(seen)
        for at in range(0, len(some), 1 << 18):
            part = some[at:at + (1 << 18)]
            yield pa.record_batch({"b": pa.array(part, pa.int32()), "n": pa.array(seen[part].astype(np.int64))})

    counts = docs.select(text_col).mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))
    # one byte per bucket: BUCKETS of them at any data size
    classes = counts.select("b", F.least(F.floor(3 * F.log2(F.col("n") + 1) + F.lit(1e-9)), F.lit(127)).cast("tinyint").alias("r")).toArrow()
    ranks = np.zeros(BUCKETS, np.int8)
    ranks[classes.column("b").to_numpy()] = classes.column("r").to_numpy()
    return ranks


def _coded(lines: pa.Array, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(line, code)`` of the distinct words of lines, by line and code."""
    line, ids, hashes = _words(lines)
    codes = (ranks[_bucket(hashes)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
    order = np.argsort(codes)
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes))
    both = np.sort(line.astype(np.int64) * len(codes) + place[ids])
    both = both[np.flatnonzero(np.diff(both, prepend=-1))]
    return both // max(len(codes), 1), codes[order][both % max(len(codes), 1)]


def _ceil(x: np.ndarray) -> np.ndarray:
    """Ceiling that forgives rounding just above an integer."""
    return np.ceil(x - 1e-9).astype(np.int64)


def _keys(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(_mixed(codes * _MIX), starts).view(np.int64)


def _list(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


WIDE = "id {id}, dh long, th long, line_no int, key long, n int, bits long, bits_2 long, pos int, code int, mark int, mark_2 int, mark_3 int"


def _wide(docs: DataFrame, id_col: str, text_col: str, ranks: np.ndarray, t: float) -> DataFrame:
    """Written to the shared folder: a row per line with words (row's id, hashes of id and text, line number, set key, number of words, marks), and
    for the first line of a set in a chunk a row per word of its prefix without words that occur once (key, number of
    words, parity map, place, 32 bits of the code)."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(id_col).alias("dh"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def code(batches):
        for batch in batches:
            for _, part in _chunks(batch, 3):
                row, number, lines = _lines(part.column(3))
                line, codes = _coded(lines, ranks)
                if not len(line):
                    continue
                starts = np.flatnonzero(np.diff(line, prepend=-1))
                n = np.diff(np.append(starts, len(line)))
                own = line[starts]
                keys = _keys(codes, starts)
                place = codes % np.uint64(64 * len(MAPS))
                maps = [np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) == k, np.uint64(1) << (place & np.uint64(63)), np.uint64(0)),
                                                starts).view(np.int64) for k in range(len(MAPS))]
                new = np.zeros(len(keys), bool)
                new[np.unique(keys, return_index=True)[1]] = True
                at = np.arange(len(line)) - np.repeat(starts, n)
                kept = at < np.repeat(np.where(new, n - _ceil(t * n) + 1, 0), n)
                kept &= (codes >> np.uint64(56)) != ONCE
                entry = np.repeat(np.arange(len(n)), n)[kept]
                known = np.flatnonzero((codes >> np.uint64(56)) != ONCE)
                of = np.repeat(np.arange(len(n)), n)[known]
                nth = np.arange(len(of)) - np.searchsorted(of, of)
                rare, has = np.zeros((3, len(n)), np.uint64), np.zeros((3, len(n)), bool)
                for k in range(3):
                    rare[k, of[nth == k]], has[k, of[nth == k]] = codes[known[nth == k]], True
                m, e = len(n), len(entry)
                # line rows, then entry rows; each kind has nulls in the other's columns
                line_row, entry_row = np.arange(m + e) >= m, np.arange(m + e) < m
                both = np.append(np.arange(m), entry)
                rows_of = pa.array(np.append(row[own], np.zeros(e, np.int64)), mask=line_row)
                pad = np.zeros(m, np.int64)
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c).take(rows_of) for c in range(3)], pa.array(number[own][both], pa.int32(), mask=line_row),
                    pa.array(keys[both]), pa.array(n[both], pa.int32()),
                    *[pa.array(bits[both], mask=entry_row) for bits in maps],
                    pa.array(np.append(pad, at[kept]), pa.int32(), mask=entry_row),
                    pa.array(np.append(pad.astype(np.int32), codes[kept].astype(np.uint32).view(np.int32)), mask=entry_row),
                    *[pa.array((_mixed(rare[i] * _MIX + rare[j]) >> np.uint64(32)).astype(np.uint32).view(np.int32)[both],
                               mask=line_row | ~has[j][both]) for i, j in combinations(range(3), 2)],
                ], names=["id", "dh", "th", "line_no", "key", "n", *MAPS, "pos", "code", *MARKS])

    return _written(rows.mapInArrow(code, WIDE.format(id=rows.schema["id"].dataType.simpleString())))


def similar_sets(entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Candidate pairs ``(a, b)`` of the sets with prefix entries ``(key, n, bits, bits_2, pos, code)``, each once: all pairs of different sets of Jaccard
    similarity ``threshold`` or more, and some below; if there is a column ``settled``, without the pairs of which both sets are. Entries are the first
    ``n - ceil(t n) + 1`` codes, rarest first; of the smaller set of a pair the first
    ``n - ceil(2 t n / (1 + t)) + 1`` are enough. A set may come several times."""
    t = F.lit(threshold)

    def ceil(x):
        return F.ceil(x - F.lit(1e-9)).cast("int")

    known = ["settled"] if "settled" in entries.columns else []
    entry = entries.select("code", "key", *MAPS, *known, F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # copies of a set meet behind the exchange that the join needs anyway, which serves both sides; those of one side
    # are left to the pairs, a pair comes at most as often as its set does
    entry = entry.repartition(parts, "code")
    one, two = entry.alias("one"), entry.distinct().alias("two")
    a, b = F.col("one.key"), F.col("two.key")
    na, nb = (F.shiftright(F.col(f"{s}.at"), 32).cast("int") for s in ("one", "two"))
    pa_, pb = (F.col(f"{s}.at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int") for s in ("one", "two"))
    sized = ((na < nb) | ((na == nb) & (a < b))) & (na >= t * nb - 1e-9)
    need = ceil(t / (1 + t) * (na + nb))
    placed = F.least(na - pa_, nb - pb) >= need
    apart = reduce(add, [F.bit_count(F.col(f"one.{m}").bitwiseXOR(F.col(f"two.{m}"))) for m in MAPS])
    mapped = na + nb - apart >= 2 * need
    # asked of the pair rather than of one side, whose exchange would differ
    short = (pa_ < na - ceil(2 * t / (1 + t) * na) + 1) | (nb < 0)
    asked = sized & mapped & placed & short
    if known:
        asked = asked & ~(F.col("one.settled") & F.col("two.settled"))
    return one.join(two, (F.col("one.code") == F.col("two.code")) & asked).select(a.alias("a"), b.alias("b")).distinct()


def _bits_of(dh: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Place of a line in the map of lines asked for."""
    mixed = _mixed(dh.view(np.uint64) * _MIX + number.astype(np.uint64))
    return (mixed >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _asked_map(asked: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the places of the lines ``(dh, line_no)`` set."""

    def mark(batches):
        seen = np.zeros(1 << (MAP_BITS - 3), np.uint8)
        for b in batches:
            at = _bits_of(b.column(0).to_numpy(), b.column(1).to_numpy())
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = seen.view("<i8")
        some = np.flatnonzero(words)
        yield pa.record_batch({"w": pa.array(some, pa.int32()), "v": pa.array(words[some], pa.int64())})

    found = asked.mapInArrow(mark, "w int, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    words = np.zeros(1 << (MAP_BITS - 6), "<i8")
    words[found.column("w").to_numpy()] = found.column("v").to_numpy()
    return words.view(np.uint8)


def _full_sets(docs: DataFrame, id_col: str, text_col: str, ranks: np.ndarray, asked: DataFrame) -> DataFrame:
    """``(key, codes)`` of the lines asked for (and of a few more whose places share a bit with theirs)."""
    wanted = _asked_map(asked)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("dh"), F.col(text_col).alias("text"))

    def code(batches):
        for batch in batches:
            for _, part in _chunks(batch, 1):
                row, number, lines = _lines(part.column(1))
                at = _bits_of(part.column(0).to_numpy()[row], number)
                line, codes = _coded(lines.filter(pa.array((wanted[at >> 3] >> (at & 7) & 1).astype(bool))), ranks)
                if not len(line):
                    continue
                starts = np.flatnonzero(np.diff(line, prepend=-1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(_keys(codes, starts)), _list(codes.view(np.int64), np.diff(np.append(starts, len(line))), pa.int64())],
                    names=["key", "codes"])

    return rows.mapInArrow(code, "key long, codes array<long>")


def _met(classes: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)``: each set with the earliest one, and with the last ones before it, of those that share a mark."""
    marks = classes.select("key", "first.id", "first.line_no", F.col("first.n").alias("n"),
                           F.explode(F.array_compact(F.array(*[F.col(f"first.{m}") for m in MARKS]))).alias("mark"))
    order = Window.partitionBy("mark").orderBy("id", "line_no", "key")
    one = F.struct("key", "n")
    others = F.array(F.first(one).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                     *[F.lag(one, k).over(order) for k in range(1, BEFORE + 1)])
    met = marks.select("key", "n", others.alias("others")).select("key", "n", F.explode("others").alias("other"))
    sized = F.least("n", "other.n") >= F.lit(threshold) * F.greatest("n", "other.n") - 1e-9
    return met.where((F.col("other.key") != F.col("key")) & sized).select(F.col("key").alias("a"), F.col("other.key").alias("b")).distinct()


def _later(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, ranks: np.ndarray,
           threshold: float) -> DataFrame:
    """``(key)``, written: of the pairs ``(a, b)`` of similar sets, those whose earliest line is the later one. Of two
    sets at one place the smaller is the later one."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    asked = _written(classes.join(keys, "key", "left_semi").select("key", "first.dh", F.struct("first.id", "first.line_no").alias("first")))
    sets = _full_sets(docs, id_col, text_col, ranks, asked.select("dh", "first.line_no"))
    sets = _written(sets.dropDuplicates(["key"]).join(asked.select("key", "first"), "key"))
    both = (pairs.join(sets.select(F.col("key").alias("a"), F.col("first").alias("fa"), F.col("codes").alias("x")), "a")
            .join(sets.select(F.col("key").alias("b"), F.col("first").alias("fb"), F.col("codes").alias("y")), "b"))
    common = F.size(F.array_intersect("x", "y"))
    same = both.where(common >= F.lit(threshold) * (F.size("x") + F.size("y") - common) - 1e-9)
    smaller = F.struct(F.size("x"), F.col("a")) < F.struct(F.size("y"), F.col("b"))
    a_later = F.when(F.col("fa") == F.col("fb"), smaller).otherwise(F.col("fa") > F.col("fb"))
    return _written(same.select(F.when(a_later, F.col("a")).otherwise(F.col("b")).alias("key")).distinct())


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(lines, classes, later)``: each line with words ``(id, th, line_no, key)``; each distinct word
    set ``(key, first, n)`` with the place ``(id, line_no)`` of its earliest line and its number of lines; and the
    sets ``(key)`` that have a similar set whose earliest line comes before theirs."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    ranks = rarity(docs, text_col)
    wide = _wide(docs, id_col, text_col, ranks, threshold)
    rows = wide.where("code is null")
    lines = rows.select("id", "dh", "th", "line_no", "key")
    classes = _written(rows.groupBy("key").agg(F.min(F.struct("id", "line_no", "dh", F.col("n"), *MARKS)).alias("first"), F.count(F.lit(1)).alias("n")))
    settled = _later(_written(_met(classes, threshold)), classes, docs, id_col, text_col, ranks, threshold)
    known = settled.withColumn("settled", F.lit(True))
    if settled.count() * 16 <= BROADCAST_BYTES:
        known = F.broadcast(known)
    entries = wide.where("code is not null").select("key", "n", *MAPS, "pos", "code")
    entries = entries.join(known, "key", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    pairs = _written(similar_sets(entries, threshold))
    later = settled.union(_later(pairs, classes, docs, id_col, text_col, ranks, threshold)).distinct()
    return lines, classes, later


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """``(id, th, removed)``: for each document with such lines, the numbers of those that an earlier
    line (by id, then line number) matches; ``th``, a hash of the text, tells texts of one id apart."""
    lines, classes, later = line_classes(docs, id_col, text_col, threshold)
    # all lines of such a set go; of other sets, all but those at the first place
    judged = (classes.join(later.withColumn("every", F.lit(True)), "key", "left").where(F.col("every") | (F.col("n") > 1))
              .select("key", F.struct("first.id", "first.line_no").alias("first"), F.coalesce("every", F.lit(False)).alias("every")))
    gone = lines.join(judged, "key").where(F.col("every") | (F.col("first") < F.struct("id", "line_no")))
    return gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with later near-duplicate lines taken out of the text, and the columns ``__lines`` (number of
    lines), ``__removed`` (numbers of the lines taken out).

    Lines are cut at line feeds, words at ASCII white space; a line without words matches nothing and stays. Lines of fewer
    than five words match equal sets, or sets of at most one word more. Null texts stay null
    with 0 lines, empty ones have one empty line. Ids may be of any type that can be ordered; rows with a null id come first in the order. Rows
    of one id share its place in the order: a line is later only than lines of smaller ids or numbers. Other columns are untouched."""
    gone = _written(removed_lines(docs, id_col, text_col, threshold).select(
        F.col("id").alias("__doc"), F.col("th").alias("__hash"), F.col("removed").alias("__gone")))
    size = gone.agg(F.sum(32 + 4 * F.size("__gone"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    marked = docs.join(gone, docs[id_col].eqNullSafe(F.col("__doc")) & (F.xxhash64(docs[text_col]) == F.col("__hash")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)
    return marked.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
                         F.coalesce(F.size(parts), F.lit(0)).alias("__lines"),
                         F.coalesce("__gone", F.array().cast("array<int>")).alias("__removed"))
