"""N-gram Jaccard join by a grouped prefix join.

1. A counting sketch of all shingles of the corpus (fixed size) gives the global order: rarer first. Its cells are
   compared with what other shingles bring to any cell, so the order stays sharp where every cell is full.
2. Each document has the prefix of its set under that order: any two documents over the threshold share a
   token of their prefixes. Equal sets collapse into a class, classes with equal prefix and size into a group.
   Of all rows only sizes and fingerprints are kept; the tokens of the groups are read again from the text.
3. Groups meet on prefix tokens. A token of few groups gives pairs, which the sizes and the number of shared
   prefix tokens filter; a token of many groups gives one star, which drops no pair, only filters none.
   Sets too small to link with any set but an equal one take no part.
4. Candidate clusters are cut into steps of size and these into blocks bounded in shingles and in sets. A block meets
   the blocks of its own and the next step only, as sets further apart in size can't link; every pair of classes that
   meets is verified exactly by a product of incidence matrices, and a spanning forest of the links goes on.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut, only, text_bytes
from panelwright.llm.components import connected_components
from panelwright.llm.shingles import mix, shingle_sets

#: Cells of the counting sketch; their levels (two bytes each, so many bits of a key) are broadcast, whatever the corpus.
SKETCH_BITS, LEVEL_BITS = 22, 10
SLICE_BITS = 14
#: Groups on a token up to which pairs are listed; beyond, the token's groups form a star.
PAIRS_UP_TO = 48
#: Shingles and sets in a block, in expectation; two blocks meet in one task.
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 1_500
#: Columns of a dense incidence matrix at a time.
COLUMNS = 8192
#: Rows of tokens in an Arrow batch, and texts that are hashed at a time.
TOKEN_ROWS, TEXTS_AT_A_TIME = 1 << 17, 1000
#: Bits of the filter of candidate ids per candidate, and its largest size.
FILTER_BITS_EACH, FILTER_BITS_MOST = 16, 1 << 28


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle sets of a text column, some texts at a time: hashing takes many times the texts' memory."""
    for lo in range(0, len(column), TEXTS_AT_A_TIME):
        yield from shingle_sets(*text_bytes(column.slice(lo, TEXTS_AT_A_TIME)), width)


def _slices(total: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    cells = total.reshape(-1, width)
    used = np.flatnonzero(cells.any(axis=1))
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(cells[i].tobytes(), 1) for i in used], pa.binary())], ["slice", "cells"])


def _summed(batches: Iterator[pa.RecordBatch], kind: str, merge) -> Iterator[pa.RecordBatch]:
    """Streams the slices and holds one array for each slice of this partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cells = np.frombuffer(zlib.decompress(raw), kind)
            sums[k] = merge(sums[k], cells) if k in sums else cells
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["slice", "cells"])


def levels_of(cells: np.ndarray) -> np.ndarray:
    """A level for each count, never falling with it: an eighth of the counts' usual spread each, then an eighth of a doubling.

    A cell holds its own shingle and, in a large corpus, many others. What these bring is the median, and differs from
    cell to cell by about its root; steps of that size tell a shingle of 50 documents from one of two in a full cell.
    """
    usual = float(np.median(cells))
    spread = max(1.0, usual) ** 0.5
    above = np.maximum(0.0, cells - max(0.0, usual - 6 * spread)) / max(1.0, spread / 8)
    half = 1 << (LEVEL_BITS - 1)
    return np.minimum(2 * half - 1, np.where(above < half, above, half + 8 * np.log2(np.maximum(above, half) / half))).astype(np.uint16)


def rarity_levels(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """The level of each cell of the sketch of all shingles of all rows."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for own in _sets(batch.column(0), width):
                cells = (own & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
                np.add.at(total, cells, np.uint32(1))
        yield from _slices(total, 1 << SLICE_BITS)

    parts = docs.select(text).mapInArrow(count, "slice int, cells binary")
    sums = parts.repartition(8, "slice").mapInArrow(lambda b: _summed(b, "uint32", np.add), "slice int, cells binary")
    total = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in sums.collect():  # at most 2 ** (SKETCH_BITS - SLICE_BITS) rows
        total[row.slice << SLICE_BITS : (row.slice + 1) << SLICE_BITS] = np.frombuffer(zlib.decompress(row.cells), np.uint32)
    return levels_of(total)


def _prefix(own: np.ndarray, level: np.ndarray, threshold: Fraction) -> np.ndarray:
    """The keys, in the global order, of the least part of a set that meets every set over the threshold."""
    cells = (own & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
    key = (level[cells].astype(np.uint64) << np.uint64(63 - LEVEL_BITS)) | (own >> np.uint64(LEVEL_BITS + 1))
    least = len(own) - math.ceil(threshold * len(own)) + 1 if len(own) else 0
    return np.sort(key)[:least]


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, threshold: Fraction, levels: Broadcast) -> DataFrame:
    """doc_id, n (size of the set), fp1, fp2 (fingerprint of the set), last (key of the prefix), prefix_hash."""

    def sign(batches):
        level = levels.value
        for batch in batches:
            n, fp, lasts, hashes = [], [], [], []
            for own in _sets(batch.column(1), width):
                prefix = _prefix(own, level, threshold)
                n.append(len(own))
                fp.append(xxhash.xxh3_128_digest(own.tobytes()))
                lasts.append(int(prefix[-1]) if len(prefix) else 0)
                hashes.append(xxhash.xxh3_64_intdigest(prefix.tobytes()) - 2**63)
            fps = np.frombuffer(b"".join(fp), np.int64).reshape(-1, 2)
            arrays = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array(lasts, pa.int64()), pa.array(hashes, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "fp1", "fp2", "last", "prefix_hash"])

    return docs.select(doc_id, text).mapInArrow(sign, "doc_id long, n long, fp1 long, fp2 long, last long, prefix_hash long")


def prefix_tokens(docs: DataFrame, doc_id: str, text: str, width: int, threshold: Fraction, levels: Broadcast, marked: Broadcast, least: int) -> DataFrame:
    """(token, gid) of the rows with sets of that least size whose id the filter may hold, read again from the text."""

    def tokens(batches):
        level = levels.value
        for batch in batches:
            part = _held(batch, marked.value)
            prefixes = [_prefix(own, level, threshold) if len(own) >= least else own[:0] for own in _sets(part.column(1), width)]
            ids = np.repeat(part.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False), [len(x) for x in prefixes])
            keys = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
            for lo in range(0, len(keys), TOKEN_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + TOKEN_ROWS]), pa.array(ids[lo : lo + TOKEN_ROWS])], ["token", "gid"])

    return docs.select(doc_id, text).mapInArrow(tokens, "token long, gid long")


def candidate_links(tokens: DataFrame, groups: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b) of groups that may hold documents over the threshold; see the module's text for why none is missed.

    Tokens of other rows than the groups' own, and tokens that come twice, may add candidates and take none away.
    """
    num, den = threshold.numerator, threshold.denominator
    w = Window.partitionBy("token")
    shared = tokens.select("token", "gid", F.count("*").over(w).alias("k"), F.min("gid").over(w).alias("leader")).where("k > 1")
    prefix = F.col("n") - F.ceil(F.col("n") * num / den - F.lit(1e-9)) + 1
    met = cut(shared.join(groups.select("gid", "n", "last", prefix.alias("p")), "gid"))
    few = met.where(F.col("k") <= PAIRS_UP_TO)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.gid") < F.col("b.gid")) & (F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num))
    pairs = pairs.groupBy(F.col("a.gid").alias("a"), F.col("b.gid").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.p").alias("pa"), F.col("b.p").alias("pb"), F.col("a.last").alias("la"), F.col("b.last").alias("lb")).agg(F.count("*").alias("c"))
    need = F.ceil((F.col("na") + F.col("nb")) * num / (num + den) - F.lit(1e-9))
    pairs = pairs.where(F.when(F.col("la") <= F.col("lb"), F.col("pa") - F.col("c") <= F.col("na") - need).otherwise(F.col("pb") - F.col("c") <= F.col("nb") - need))
    stars = met.where((F.col("k") > PAIRS_UP_TO) & (F.col("gid") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("gid").alias("b"))
    return pairs.select("a", "b").unionByName(stars)


def _id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A bit for each hash of an id, in a size that follows n up to a bound; a wrong hit costs a row moved, no result."""
    bits = 1 << max(16, min(FILTER_BITS_MOST.bit_length() - 1, math.ceil(math.log2(max(2, n * FILTER_BITS_EACH)))))
    width = min(bits // 8, 1 << 16)

    def mark(batches):
        total = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            place = (mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(total, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        yield from _slices(total, width)

    parts = ids.mapInArrow(mark, "slice int, cells binary").repartition(8, "slice").mapInArrow(lambda b: _summed(b, "uint8", np.bitwise_or), "slice int, cells binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():  # bits // 8 bytes in all, at most FILTER_BITS_MOST // 8
        out[row.slice * width : (row.slice + 1) * width] = np.frombuffer(zlib.decompress(row.cells), np.uint8)
    return out


def _held(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows whose id (the first column) the filter may hold."""
    ids = batch.column(0).cast(pa.int64())
    place = (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    hit = ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
    return batch.filter(pc.and_(pa.array(hit), pc.is_valid(ids)))


def _sets_of(docs: DataFrame, doc_id: str, text: str, width: int, marked: np.ndarray) -> DataFrame:
    """(rep, cells) of the rows whose id the filter may hold, read again from the text: sets are never stored for all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def encode(batches):
        for batch in batches:
            part = _held(batch, shared.value)
            if part.num_rows:
                cells = [own.tobytes() for own in _sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(cells, pa.binary())], ["rep", "cells"])

    return docs.select(doc_id, text).mapInArrow(encode, "rep long, cells binary")


def size_step(n: Column, threshold: Fraction) -> Column:
    """Sets that link are in the same step of sizes or in neighbouring ones: a step is a little wider than the threshold's ratio."""
    width = -math.log(threshold) * (1 + 1e-9) if threshold < 1 else 1e-9
    return F.floor(F.log(n.cast("double")) / F.lit(width)).cast("int")


def _forest(reps: np.ndarray, sets: list[np.ndarray], first: np.ndarray | None, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (a, b) of the exact links among the sets; first: only links between its sets and the others count."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    rows, columns = (np.arange(m), np.arange(m)) if first is None else (np.flatnonzero(first), np.flatnonzero(~first))
    place = np.empty(m, np.int64)
    ids, cells = np.repeat(np.arange(m), sizes), np.concatenate(sets)
    order = np.argsort(cells, kind="stable")
    cells, ids = cells[order], ids[order]
    begins = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
    runs = np.diff(np.append(begins, len(cells)))
    keep = runs > 1
    column = np.repeat(np.where(keep, np.cumsum(keep) - 1, -1), runs)
    ids, column = ids[column >= 0], column[column >= 0]
    both, total = np.zeros((len(rows), len(columns)), np.float64 if sizes.max(initial=0) >> 24 else np.float32), int(keep.sum())
    for lo in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((m, min(COLUMNS, total - lo)), np.float32)
        part[ids[a:b], column[a:b] - lo] = 1
        both += part @ part.T if first is None else part[rows] @ part[columns].T
    place[rows], place[columns] = np.arange(len(rows)), np.arange(len(columns))
    num, den = threshold.numerator, threshold.denominator
    linked = np.empty(both.shape, bool)
    for r, i in enumerate(rows.tolist()):
        shared = np.rint(both[r]).astype(np.int64)
        linked[r] = shared * den >= num * (sizes[i] + sizes[columns] - shared)
    left, right, seen = [], [], np.zeros(m, bool)
    for root in range(m):
        if seen[root]:
            continue
        seen[root], stack = True, [root]
        while stack:
            x = stack.pop()
            near = columns[linked[place[x]]] if first is None or first[x] else rows[linked[:, place[x]]]
            new = near[~seen[near]]
            seen[new] = True
            left += [reps[x]] * len(new)
            right += reps[new].tolist()
            stack += new.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, class_id, component_id.

    Documents link when the Jaccard similarity of their sets of word shingles is at least threshold. class_id is the
    smallest doc_id with an equal set, component_id the smallest reachable by links. Null or wordless text: an empty
    set, linked with nothing, both ids its own. A null doc_id: ids null, linked with nothing. Repeated rows stay
    repeated; rows with one doc_id and different texts count as one document with the links of all of them; other
    columns are ignored; an empty table gives an empty table.
    """
    docs = only(docs, doc_id, text)
    broadcast = docs.sparkSession.sparkContext.broadcast
    levels = broadcast(rarity_levels(docs, text, width))
    signed = cut(signatures(docs, doc_id, text, width, threshold, levels))
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("last").alias("last"), F.first("prefix_hash").alias("prefix_hash"))
    classes = cut(classes)
    least = math.ceil(threshold / (1 - threshold)) if threshold < 1 else 1 << 62  # smaller sets link with equal ones only
    groups = classes.where(F.col("n") >= least).groupBy("n", "prefix_hash").agg(F.min("rep").alias("gid"), F.first("last").alias("last"), F.count("*").alias("members"))
    groups = cut(groups)
    tokens = prefix_tokens(docs, doc_id, text, width, threshold, levels, broadcast(_id_filter(groups.select("gid"), groups.count())), least)
    found = connected_components(candidate_links(tokens, groups, threshold), "a", "b")
    clustered = groups.select("n", "prefix_hash", "gid", "members").join(found.withColumnRenamed("id", "gid"), "gid", "left").where("component IS NOT NULL OR members > 1")
    candidates = cut(classes.join(clustered.select("n", "prefix_hash", F.coalesce("component", "gid").alias("cluster")), ["n", "prefix_hash"]).select("rep", "n", "cluster", size_step(F.col("n"), threshold).alias("step")))
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    steps = cut(candidates.groupBy("cluster", "step").agg(blocks.alias("blocks"), F.count("*").alias("reps")))
    # what each step meets: its own blocks, if it has two sets at least, and those of the steps beside it
    beside = steps.select("cluster", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), F.col("step").alias("other_step"), F.col("blocks").alias("other_blocks"))
    meets = steps.join(beside, ["cluster", "step"]).where("step <> other_step OR reps > 1")
    meets = cut(meets.select("cluster", "step", "blocks", "other_step", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("other_block")))
    partners = meets.groupBy("cluster", "step", "blocks").agg(F.collect_list(F.struct("other_step", "other_block")).alias("others"))
    candidates = cut(candidates.join(partners, ["cluster", "step"]).select("rep", "cluster", "step", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), "others"))
    marked = _id_filter(candidates.select("rep"), candidates.count())
    placed = _sets_of(docs, doc_id, text, width, marked).join(candidates, "rep").select("rep", "cells", "cluster", F.struct("step", "block").alias("own"), F.explode("others").alias("o"))
    placed = placed.withColumn("other", F.struct(F.col("o.other_step").alias("step"), F.col("o.other_block").alias("block")))
    placed = placed.select("rep", "cells", "cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("first"))

    def verify(key, group):
        if group.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        reps = group.column("rep").to_numpy()
        first = None if key[1].as_py() == key[2].as_py() else group.column("first").to_numpy(zero_copy_only=False).astype(bool)
        a, b = _forest(reps, [np.frombuffer(x, np.uint64) for x in group.column("cells").to_pylist()], first, threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = placed.groupBy("cluster", "low", "high").applyInArrow(verify, "a long, b long")
    parts = connected_components(links, "a", "b").withColumnRenamed("id", "rep")
    named = classes.select("n", "fp1", "fp2", "rep").join(parts, "rep", "left").select("n", "fp1", "fp2", "rep", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n", "fp1", "fp2").join(named, ["n", "fp1", "fp2"], "left")
    usable = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(usable, F.coalesce("rep", "doc_id")).alias("class_id"), F.when(usable, F.coalesce("component", "doc_id")).alias("component_id"))
