"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

Texts are lower-cased and white space is collapsed. A test item of ``m`` characters has an
error budget ``k`` (a share of m). It is cut into k + 1 pieces; a passage within k edits of the
item must hold at least one piece unchanged. All pieces are found in one Aho-Corasick scan
of each document. A hit is verified by Myers' distance in a window that any passage within the
budget must lie in, first for the piece and its neighbour, then for twice as many pieces, up
to the whole item: of the pieces under a node of this binary tree with budget (pieces - 1),
one half keeps its own budget, so a true passage passes at every level above one of its
pieces, and chance hits end after a few characters.

The items are a query set. They are normalised by Spark, dealt by a hash into blocks of about
``BLOCK_CHARS`` characters and written once to the shared folder; a task reads the one block that
it scans for. Neither the driver nor a plan ever holds items, and a task holds one block, so
nothing grows with the benchmark but the number of blocks and of scans.
"""

from __future__ import annotations

import functools
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindscape.llm.files import file_system
from bindscape.session import shared_dir

ERROR_RATE = 0.10
#: Characters of test items that one scan holds in each task, on average of the blocks.
BLOCK_CHARS = 1 << 20
#: Tasks that the rows of one text meet its hits in.
SPREAD = 8


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item of ``length`` characters (fewer than it has)."""
    return max(0, min(int(length * rate), length - 1))


def pieces(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of near equal length with their positions."""
    n = budget(len(item), rate) + 1
    edge = [len(item) * i // n for i in range(n + 1)]
    return [(edge[i], item[edge[i]:edge[i + 1]]) for i in range(n)]


def letter_masks(item: str) -> dict[str, int]:
    """Bit i of a letter's mask: the item has it at position i."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers_best(masks: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int]:
    """Smallest edit distance of an item of ``m`` letters to any substring of ``text`` and the end of
    the first such substring; (limit + 1, -1) if none is within ``limit`` (less than m).
    Bit-parallel: one integer holds a column of the edit matrix."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, where = mask, 0, m, limit + 1, -1
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        pv = (mh << 1 | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best, where = score, i + 1
    return best, where


class Matcher:
    """Aho-Corasick over the pieces of a block of items, and their trees of nodes."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float):
        import ahocorasick
        self.items, self.rate = items, rate
        self._masks: dict[tuple, dict[str, int]] = {}
        found: dict[str, list] = {}
        for k, (_, item) in enumerate(items):
            cut = pieces(item, rate)
            ends = [at for at, _ in cut[1:]] + [len(item)]
            self._grow(k, item, cut, ends, 0, len(cut), (), found)
        self.pieces = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.pieces.add_word(piece, (len(piece), uses))
        self.pieces.make_automaton()

    def _grow(self, k, item, cut, ends, lo, hi, above, found):
        """A node over pieces lo..hi; a leaf notes the nodes above it, the lowest first."""
        start, end = cut[lo][0], ends[hi - 1]
        node = (start, end - start, hi - lo - 1)
        if hi - lo == 1:
            found.setdefault(cut[lo][1], []).append((k, start, above or (node,)))
            return
        mid = (lo + hi) // 2
        for a, b in ((lo, mid), (mid, hi)):
            self._grow(k, item, cut, ends, a, b, (node, *above), found)

    def masks(self, k: int, start: int, m: int) -> dict[str, int]:
        """Letter masks of a node, made when its first hit asks for them."""
        got = self._masks.get((k, start, m))
        if got is None:
            got = self._masks[k, start, m] = letter_masks(self.items[k][1][start:start + m])
        return got

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item_id, distance, end)`` for each item that the text holds within its budget: the
        smallest distance and where (in the normalised text) the first passage of it ends."""
        s = normalise(text)
        if not s or not self.items:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        roots = {}
        for end, (n, uses) in self.pieces.iter(s):
            begin = end - n + 1
            for k, at, nodes in uses:
                for start, m, limit in nodes[:-1]:
                    first = begin - (at - start)
                    near = s[max(0, first - limit):first + m + limit]
                    if myers_best(self.masks(k, start, m), m, near, limit)[0] > limit:
                        break
                else:
                    _, m, limit = roots[k] = nodes[-1]
                    first = begin - at
                    windows.setdefault(k, []).append((max(0, first - limit), min(len(s), first + m + limit)))
        out = []
        for k, spans in windows.items():
            start, m, limit = roots[k]
            masks = self.masks(k, start, m)
            spans.sort()
            best, where, i = limit + 1, -1, 0
            while i < len(spans):
                lo, hi = spans[i]
                i += 1
                while i < len(spans) and spans[i][0] <= hi:
                    hi = max(hi, spans[i][1])
                    i += 1
                d, at = myers_best(masks, m, s[lo:hi], best - 1)
                if d < best:
                    best, where = d, lo + at
            if best <= limit:
                out.append((self.items[k][0], best, where))
        return sorted(out)


@functools.lru_cache(maxsize=2)
def block_matcher(folder: str, block: int, rate: float) -> Matcher:
    """The matcher of one written block, kept by the worker for its next task."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector
    fs, root = file_system(f"{folder}/block={block}")
    items = set()
    for info in fs.get_file_info(FileSelector(root)):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                table = pq.read_table(f, columns=["item_id", "text"])
            items.update(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    return Matcher(tuple(sorted(items)), rate)


def write_blocks(benchmark: DataFrame, folder: str, item_id: str = "item_id", item_text: str = "text",
                 block_chars: int = BLOCK_CHARS) -> list[int]:
    """Write the distinct normalised items to ``folder`` (shared storage) in blocks of about ``block_chars``
    characters, as Parquet partitioned by block; the numbers of the blocks that hold items.
    Items with a null id or without a letter are left out."""

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([normalise(t.as_py()) for t in texts], pa.string())

    items = (benchmark.where(F.col(item_id).isNotNull())
             .select(F.col(item_id).cast("long").alias("item_id"), normal(F.col(item_text)).alias("text")).distinct())
    items.write.parquet(f"{folder}/items")
    items = benchmark.sparkSession.read.parquet(f"{folder}/items").where("text <> ''")
    n, chars = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    if not n:
        return []
    blocks = min(n, -(-chars // block_chars))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(f"{folder}/blocks")
    return sorted(r["block"] for r in dealt.select("block").distinct().collect())


_LEAKS = "array<struct<item_id:bigint,distance:int,end:bigint>>"
_LEAKS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())]))


def _leaks(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    return pa.array([[{"item_id": i, "distance": d, "end": e} for i, d, e in row] for row in found], _LEAKS_ARROW)


def _matched(text: Column, folder: str, block: int, rate: float) -> Column:
    @F.arrow_udf(_LEAKS)
    def compute(texts: pa.Array) -> pa.Array:
        matcher = block_matcher(folder, block, rate)
        return _leaks([matcher.matches(t.as_py()) for t in texts])

    return compute(text)


def scan_block(folder: str, block: int, rate: float):
    """A ``mapInArrow`` function from ``(h, text)`` to ``(h, leaks)`` of the texts that hold an item of the block."""
    def scan(batches):
        matcher = block_matcher(folder, block, rate)
        for b in batches:
            found = [(h.as_py(), m) for h, t in zip(b.column(0), b.column(1), strict=True)
                     if (m := matcher.matches(t.as_py()))]
            if found:
                keys, rows = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), _leaks(rows)], names=["h", "leaks"])

    return scan


def _by_passes(docs: DataFrame, text_col: str, folder: str, blocks: list[int], rate: float, out: str) -> DataFrame:
    """One pass over the texts per block, its hits written before the next begins; the hits of each text
    then meet its rows. Rows are spread by all their plain columns, so a frequent text is no hot key."""
    spark = docs.sparkSession
    texts = docs.select(F.sha2(F.col(text_col), 256).alias("h"), F.col(text_col).alias("t")).where("t <> ''")
    for block in blocks:
        hits = texts.mapInArrow(scan_block(f"{folder}/blocks", block, rate), f"h string, leaks {_LEAKS}")
        hits.dropDuplicates(["h"]).write.parquet(f"{folder}/hits/pass={block}")
    hits = spark.read.schema(f"h string, leaks {_LEAKS}, pass int").parquet(f"{folder}/hits")
    hits = (hits.groupBy("h").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
            .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("row"), F.sha2(F.col(text_col), 256).alias("h"),
                       F.pmod(F.xxhash64(*plain), F.lit(SPREAD)).cast("int").alias("s"))
    return rows.join(hits, ["h", "s"], "left").select(
        "row.*", F.coalesce("leaks", F.array().cast(_LEAKS)).alias(out))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
               out: str = "leaks") -> DataFrame:
    """``docs`` with the array ``out`` of ``(item_id, distance, end)``, the items that occur in the text
    within their error budget, in order of id (empty if none). A column of that name is replaced.

    Null and empty texts hold none. Null or blank items match nothing; an item id with several
    texts is matched with each. An item too short for an error budget (under 10 characters at
    the default rate) must occur letter by letter, inside of words too: ``a`` marks every text with
    that letter. Repeated rows repeat; an empty benchmark marks nothing. The items of one
    block are matched in the pass that reads the rows; several blocks take a pass each."""
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/decontam-{uuid.uuid4().hex}"
    blocks = write_blocks(benchmark, folder, item_id, item_text, block_chars)
    docs = docs.drop(out)
    if not blocks:
        return docs.withColumn(out, F.array().cast(_LEAKS))
    if len(blocks) == 1:
        return docs.withColumn(out, _matched(F.col(text_col), f"{folder}/blocks", blocks[0], rate))
    return _by_passes(docs, text_col, folder, blocks, rate, out)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = ERROR_RATE,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns unchanged."""
    out = "leaks"
    while out in {c.lower() for c in docs.columns}:
        out += "_"
    marked = find_leaks(docs, benchmark, text_col, rate=rate, block_chars=block_chars, out=out)
    return marked.where(F.size(out) == 0).drop(out)
