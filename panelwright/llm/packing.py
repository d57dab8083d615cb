"""Best-two-fit packing of token pieces into sequences of a fixed length.

Pieces of one length are interchangeable, so the packing is planned on the counts of the lengths (at most one count
for each length up to the sequence length, whatever the corpus) and then dealt out to the pieces by their rank
within their length. A bin is filled greedily, longest first; its shortest piece is then replaced by the two
unpacked pieces that fill the gap it leaves more tightly. A finished bin is repeated as often as the counts allow.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut, only
from panelwright.llm.encode import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """[(lengths in a bin and how often each, number of such bins)], which use up the counts."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []

    def below() -> np.ndarray:
        """For each length, the longest unpacked one that is no longer; 0: none."""
        return np.maximum.accumulate(np.where(free > 0, np.arange(size + 1), 0))

    while True:
        free = left.copy()
        fits = below()
        bin_, gap = Counter(), size
        while gap and (length := int(fits[gap])):
            n = min(int(free[length]), gap // length)
            bin_[length] += n
            gap -= n * length
            free[length] -= n
            if not free[length]:
                fits = below()
        if not bin_:
            return out
        if gap:
            least = min(bin_)
            room = gap + least
            one = np.flatnonzero(free[: room + 1])
            one = one[one >= (room + 1) // 2]  # the longer of the two, or an equal pair
            two = np.minimum(fits[room - one], one)
            short = np.flatnonzero(free[: room + 1])
            short = short[short < (room + 1) // 2]
            pairs = [(int(a), int(b)) for a, b in zip(one, two) if b and (a != b or free[a] > 1)]
            pairs += [(int(a), int(a)) for a in short[-1:] if free[a] > 1] + ([(int(short[-1]), int(short[-2]))] if len(short) > 1 else [])
            best = max(pairs, key=lambda p: (p[0] + p[1], p[0]), default=(0, 0))
            if best[0] + best[1] > least:
                bin_[least] -= 1
                bin_.update(best)
                bin_ = +bin_
        times = min(int(left[k]) // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= n * times
        out.append((dict(bin_), times))


def _dealt(bins: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Rows (length, ranks from, first sequence, pieces of this length in a sequence, offset of the first), by length and rank."""
    rows, used, first = [], Counter(), 0
    for bin_, times in bins:
        offset = 0
        for length in sorted(bin_, reverse=True):
            n = bin_[length]
            rows.append((length, used[length], first, n, offset))
            used[length] += n * times
            offset += n * length
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T.copy()))


def cut_pieces(docs: DataFrame, doc_id: str, text: str, vocabulary: str, end_id: int, size: int, with_ids: bool) -> DataFrame:
    """One row for each piece, with its task's number (part) and its rank among the task's pieces of its length."""

    def cut_up(batches):
        enc, part, ranks = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            ids_of, at = batch.column(0).cast(pa.int64()), 0
            for ids, offsets in enc.rows(batch.column(1)):
                n = len(offsets) - 1
                rows: list[tuple] = []
                whole = np.insert(ids, offsets[1:], end_id).astype("<u4")
                bounds = (offsets + np.arange(n + 1)).tolist()
                for i in range(n):
                    for k, lo in enumerate(range(bounds[i], bounds[i + 1], size)):
                        hi = min(lo + size, bounds[i + 1])
                        rows.append((i, k, lo - bounds[i], hi - lo, zlib.crc32(whole[lo:hi]), part, ranks[hi - lo], lo))
                        ranks[hi - lo] += 1
                own = np.array(rows, np.int64).reshape(-1, 8).T
                columns = [ids_of.slice(at, n).take(pa.array(own[0])), pa.array(own[1].astype(np.int32)), *map(pa.array, own[2:5]), pa.array(own[5].astype(np.int32)), pa.array(own[6])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(own[7], len(whole)), pa.int32()), pa.array(whole.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                at += n

    return docs.select(doc_id, text).mapInArrow(cut_up, PIECE_SCHEMA + ", part int, rank long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, size: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    A document is its token ids and then end_id; only one longer than size is cut, the last piece may be shorter.
    Null or empty text gives the end id alone; a null doc_id stays null; repeated rows are packed each; other columns
    are ignored; an empty table gives an empty table. Sequences are numbered from 0 without gaps, offsets too.
    """
    pieces = cut(cut_pieces(only(docs, doc_id, text), doc_id, text, vocabulary, end_id, size, with_ids))
    spark = docs.sparkSession
    cells = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    dealt = spark.sparkContext.broadcast(_dealt(plan_bins(totals, size)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["length", "part"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*columns, (F.col("first") + F.col("rank")).alias("rank"), *["ids"] * with_ids)

    def place(batches):
        plan = dealt.value
        keys = plan["length"] * (1 << 44) + plan["rank"]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            nth, each = rank - plan["rank"][row], plan["each"][row]
            sequence, offset = plan["sequence"][row] + nth // each, plan["offset"][row] + nth % each * length
            names = [*columns, "sequence_id", "offset", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]], names)

    return ranked.mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long" + ", ids array<int>" * with_ids)
