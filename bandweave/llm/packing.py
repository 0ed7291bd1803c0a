"""Bulk-synchronous best-fit packing of tokenized documents into sequences of bounded length.

A document is its token ids and the end id. Only a document longer than `capacity` is cut, into pieces
of `capacity` ids, of which the first may be shorter. Pieces are packed best-fit, the longest first:

1. Pieces are range-sorted by length. Length classes (capacity/2, capacity], (capacity/4, capacity/2] and so on
   follow one another.
2. A sweep range-sorts the open pieces of a class together with the gaps that take some of them, from large to small.
   A gap of g stands there with g div m places, m being the longest open piece, so that all its places can be taken.
   Walking down this order, every piece gets its successor: the smallest gap above it with a place that no piece of
   a higher rank has taken. These are the pairs of a bracket sequence, gaps opening and pieces closing: a task matches
   those of its own range, what it leaves is so many pieces and then so many places, and pairs across ranges follow from the
   two counts of each range alone. So a sweep's result depends on the order, not on the number of ranges, of which there is one for
   each `range_rows` pieces and places. Where one range holds them all, its task goes on from sweep to sweep by itself.
3. Gaps are updated, and the class is swept again as long as pieces are open. Where no gap takes the smallest of them, new
   sequences are opened: as many as the open pieces' ids fill, or one for each piece of over half of the capacity.
4. The sweeps in which its pieces came, and their places there, give the order inside a sequence.

The driver sees one row for each class and for each range of a sweep. The number of sweeps grows with the logarithms of
the capacity and of the number of pieces. Every sweep's results are tables in the shared folder. On the test tables there
are as many sequences as piece by piece best fit gives.

Cases: a null or empty text is the end id alone. Rows that repeat a doc_id are packed one by one. An empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from bandweave.llm.common import dropped, in_arrow, map_arrow, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CAPACITY = 2048


#: White space in one run that the rank encoder's pattern can't take (its stack ends near a million).
LONG_BLANK = re.compile(r"\s{100000}")


def encoder(ranks_file: str, pattern: str, json_file: str, added: bool = False):
    """text -> ids, as the tokenizer of json_file gives. The rank file has the same vocabulary, and its merges run
    several times faster; texts with very long white space go to the tokenizer itself. added: the literal of an
    added token (<|endoftext|>) is that token, as the tokenizer's default is; else it is text like any other."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    with open(json_file, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"] if added else []
    #: Tokens that take blanks beside them, or stand for whole words only, are left to the tokenizer.
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in tokens)
    words = {t["content"]: t["id"] for t in tokens}
    ranks_of = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={w: r for w, r in ranks.items() if r not in words.values()}, special_tokens=words)
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        special = any(w in text for w in words)
        if (plain or not special) and (len(text) < 100_000 or not LONG_BLANK.search(text)):
            return ranks_of.encode(text, allowed_special="all") if special else ranks_of.encode_ordinary(text)
        if not slow:
            slow.append(Tokenizer.from_file(json_file))
            slow[0].encode_special_tokens = not added
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def default_encoder(added: bool = False):
    import public_tokenizers as P

    return encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json"), added)


def contract_encoder():
    """The ids of the unaltered tokenizer."""
    return default_encoder(added=True)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized(docs: DataFrame, capacity: int = CAPACITY, make_encoder=contract_encoder, end: int = 0) -> DataFrame:
    """PIECES' columns: every piece of every document."""

    def make():
        encode = make_encoder()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    for column, value in zip(out, (doc_id.as_py(), i, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, PIECES)


#: What a sweep gives: a piece at a place of a sequence with so large a gap, an open piece (no sequence) or a place that is
#: left (no piece). part, at: the range, and which of the range's open pieces or places left it is.
MET = f"sweep int, part int, at long, sequence_id long, place int, gap long, row long, tie long, {PIECES}"
OF_PLACE, OF_PIECE = ("sequence_id", "place", "gap"), ("row", "tie", *(x.split()[0] for x in PIECES.split(", ")))


def brackets(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a sequence of opening (True) and closing brackets: the positions of matched opening ones and of the closing ones that
    they meet, of closing ones that are left and of opening ones that are."""
    depth = np.cumsum(np.where(opens, 1, -1))
    level = np.where(opens, depth, depth + 1)  # brackets of a level open and close in turn
    order = np.argsort(level, kind="stable")
    level, kind = level[order], opens[order]
    pair = np.flatnonzero((level[1:] == level[:-1]) & kind[:-1] & ~kind[1:])
    met = np.zeros(len(opens), bool)
    met[order[pair]] = met[order[pair + 1]] = True
    return order[pair], order[pair + 1], np.flatnonzero(~met & ~opens), np.flatnonzero(~met & opens)


def crossings(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """left: (range, open pieces, places left), in order. Rows (range, first piece, pieces, range of their places, place of
    the first): the next piece has the place before, and so on."""
    stack: list[list[int]] = []  # ranges with places left, and how many
    out = []
    for part, pieces, places in left:
        first = 0
        while first < pieces and stack:
            n = min(pieces - first, stack[-1][1])
            out.append((part, first, n, stack[-1][0], stack[-1][1] - 1))
            first += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if places:
            stack.append([part, places])
    return out


def joined(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """OF_PLACE and OF_PIECE of both: places have no piece, pieces no place."""
    sides = pieces.withColumns({c: F.lit(None).cast("long") for c in OF_PLACE}), places.withColumn("row", F.lit(None).cast("long"))
    return sides[0].unionByName(sides[1], allowMissingColumns=True).select(*OF_PLACE, *OF_PIECE)


def records(whole: pa.Table, places: dict[str, np.ndarray], met: list[tuple[np.ndarray | None, np.ndarray | None]], sweep: int, part: int) -> Iterator[pa.RecordBatch]:
    """MET's rows for (positions in places, rows of whole) of pairs, open pieces (None, ...) and places left (..., None)."""
    names = [x.split()[0] for x in MET.split(", ")]
    kinds = [pa.int64() if x.split()[1] == "long" else pa.int32() for x in MET.split(", ")]
    for at_place, at_piece in met:
        n = len(at_piece if at_place is None else at_place)
        columns = {"sweep": pa.array(np.full(n, sweep)), "part": pa.array(np.full(n, part)), "at": pa.array(np.arange(n))}
        columns |= {c: pa.nulls(n, pa.int64()) if at_place is None else pa.array(places[c][at_place]) for c in OF_PLACE}
        columns |= {c: pa.nulls(n, pa.int64()) if at_piece is None else whole.column(c).take(pa.array(at_piece)) for c in OF_PIECE}
        yield from pa.table([columns[c].cast(k) for c, k in zip(names, kinds, strict=True)], names).combine_chunks().to_batches()


def meet(pieces: DataFrame, places: DataFrame, number: int, ranges: int) -> DataFrame:
    """One sweep's table, as MET: pieces (OF_PIECE) and places (OF_PLACE) in one descending order, matched in each range."""
    order = [F.coalesce("gap", "length").desc(), F.col("gap").isNull(), F.coalesce("tie", "sequence_id"), F.coalesce(F.col("row"), F.col("place"))]
    ranged = joined(pieces, places).repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if batches := list(batches):
            whole = pa.Table.from_batches(batches)
            place, piece, no_place, no_piece = brackets(whole.column("gap").is_valid().to_numpy())
            held = {c: whole.column(c).fill_null(0).to_numpy() for c in OF_PLACE}
            yield from records(whole, held, [(place, piece), (None, no_place), (no_piece, None)], number, TaskContext.get().partitionId())

    return written(in_arrow(ranged, run, MET), f"sweep-{number}")


def sweeps_of_a_range(length: np.ndarray, tie: np.ndarray, row: np.ndarray, sequence: np.ndarray, gap: np.ndarray, opened: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All sweeps of a class whose pieces and gaps are one range, where no sweep has to wait for other tasks: sequence and place of
    each piece (places ascend from sweep to sweep), and all sequences with their gaps before the first sweep."""
    first = sequence, gap
    gap, of, at = gap.copy(), np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    left, number = np.lexsort([row, tie, -length]), 0
    while len(left):
        size = length[left]
        least, most = int(size[-1]), int(size[0])
        offered = np.flatnonzero(gap >= least)
        if not len(offered):
            more = len(left) if 2 * least > capacity else -(-int(size.sum()) // capacity)
            sequence, gap = np.append(sequence, np.arange(opened, opened + more)), np.append(gap, np.full(more, capacity))
            first, opened = (sequence, np.append(first[1], np.full(more, capacity))), opened + more
            continue
        offered = offered[np.lexsort([sequence[offered], -gap[offered]])]
        n = np.maximum(1, gap[offered] // most)
        owner = np.repeat(offered, n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort([np.concatenate([np.zeros(len(owner), int), np.ones(len(left), int)]), -np.concatenate([gap[owner], size])])
        opens = order < len(owner)
        where, who, _, _ = brackets(opens)
        where, who = order[where], order[who] - len(owner)
        of[left[who]], at[left[who]] = sequence[owner[where]], number * (capacity + 1) + place[where]
        gap -= np.bincount(owner[where], weights=size[who], minlength=len(gap)).astype(np.int64)
        keep = np.ones(len(left), bool)
        keep[who] = False
        left, number = left[keep], number + 1
    return of, at, *first


def finish(pieces: DataFrame, gaps: DataFrame, number: int, opened: int, capacity: int) -> DataFrame:
    """The same table for all sweeps of a class that is one range: every piece at its place, and the gaps that took none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if batches := list(batches):
            whole = pa.Table.from_batches(batches)
            is_gap = whole.column("gap").is_valid().to_numpy()
            docs, held = np.flatnonzero(~is_gap), whole.filter(pa.array(is_gap))
            column = lambda c: whole.column(c).fill_null(0).to_numpy()[docs]
            of, at, sequence, gap = sweeps_of_a_range(column("length"), column("tie"), column("row"), held.column("sequence_id").to_numpy(), held.column("gap").to_numpy(), opened, capacity)
            by = np.argsort(sequence)
            took = by[np.searchsorted(sequence, of, sorter=by)]
            idle = np.setdiff1d(np.arange(len(sequence)), took)
            yield from records(whole, {"sequence_id": of, "place": at, "gap": gap[took]}, [(np.arange(len(docs)), docs)], number, 0)
            yield from records(whole, {"sequence_id": sequence[idle], "place": np.zeros(len(idle), np.int64), "gap": gap[idle]}, [(np.arange(len(idle)), None)], number, 0)

    return written(in_arrow(joined(pieces, gaps.withColumn("place", F.lit(0))).coalesce(1), run, MET), f"sweep-{number}")


def figures(met: DataFrame, *by, **also) -> DataFrame:
    """Number, least, greatest and total length of the open pieces of a table like MET."""
    length = F.when(F.col("sequence_id").isNull(), F.col("length"))
    return met.groupBy(*by).agg(F.count(length).alias("n"), F.min(length).alias("least"), F.max(length).alias("most"), F.sum(length).alias("ids"), *(c.alias(n) for n, c in also.items()))


def swept(pieces: DataFrame, capacity: int, range_rows: int) -> list[DataFrame]:
    """pieces (OF_PIECE), a table range-sorted by length -> tables of MET that together give every piece its place."""
    spark, names = pieces.sparkSession, [x.split()[0] for x in MET.split(", ")]
    grade = F.floor(F.log2(F.lit(float(capacity)) / F.col("length"))).cast("int")  # class 0: more than half of the capacity
    classes = sorted(figures(pieces.withColumn("sequence_id", F.lit(None)), grade.alias("grade")).collect(), key=lambda c: c.grade)  # as many rows as the capacity has bits
    gaps, largest, opened, done, number, placed = spark.createDataFrame([], "sequence_id long, gap long"), 0, 0, 0, 0, []
    for known in classes:
        docs, now = pieces.where(F.col("length").between(known.least, known.most)), known
        while now.n:
            if now.n + opened <= range_rows:
                met = finish(docs, gaps.where(F.col("gap") >= now.least), number, opened, capacity)
                placed.append(met.where("row is not null"))
                full = met.groupBy("sequence_id").agg((F.max("gap") - F.coalesce(F.sum("length"), F.lit(0))).alias("gap")).where("gap > 0")
                seen, old = Observation(), gaps
                gaps = written(gaps.where(F.col("gap") < now.least).union(full).observe(seen, F.max("gap").alias("largest")), f"gaps-{number}")
                opened = max(opened, 1 + met.agg(F.max("sequence_id").alias("last")).first().last)
                largest, number, done = seen.get["largest"] or 0, number + 1, done + now.ids
                dropped(old)
                break
            if largest < now.least:
                more = now.n if known.grade == 0 else -(-now.ids // capacity)
                gaps = gaps.union(spark.range(opened, opened + more).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("gap")))
                opened, largest = opened + more, capacity
            offered = gaps.where(F.col("gap") >= now.least).withColumn("_last", (F.greatest(F.lit(1).cast("long"), F.expr(f"gap div {now.most}")) - 1).cast("int"))
            places = offered.select("sequence_id", F.explode(F.sequence(F.lit(0), "_last")).alias("place"), "gap")
            free = opened * capacity - done
            met = meet(docs, places, number, -(-(now.n + min(free // now.least, opened + free // now.most)) // range_rows))
            docs, touched = met.where("sequence_id is null"), met.where("sequence_id is not null").select("sequence_id", "gap", "length")
            placed.append(met.where("sequence_id is not null and row is not null"))
            ranges = figures(met, "part", places=F.count_if(F.col("row").isNull())).orderBy("part").collect()  # a row for each range
            cross = crossings([(r.part, r.n, r.places) for r in ranges])
            if cross:
                spans = F.broadcast(spark.createDataFrame(cross, "_of int, _first long, _n long, _part int, _place long"))
                found = docs.join(spans, (F.col("part") == F.col("_of")) & (F.col("at") >= F.col("_first")) & (F.col("at") < F.col("_first") + F.col("_n")), "left")
                going = found.where("_part is not null").select(F.col("_part").alias("part"), (F.col("_place") - (F.col("at") - F.col("_first"))).alias("at"), *OF_PIECE)
                left = met.where("row is null").select("sweep", "part", "at", *OF_PLACE)
                crossed = written(left.join(going, ["part", "at"]).select(*names), f"crossed-{number}")
                placed.append(crossed)
                docs, touched = found.where("_part is null"), touched.union(crossed.select("sequence_id", F.lit(None).cast("long"), "length"))
                ranges = figures(docs).collect()
            docs, before, least = docs.select(*OF_PIECE), now.ids, now.least
            now = Row(n=sum(r.n for r in ranges), least=min((r.least for r in ranges if r.n), default=0), most=max((r.most for r in ranges if r.n), default=0), ids=sum(r.ids for r in ranges if r.n))
            done += before - now.ids
            rest = touched.groupBy("sequence_id").agg((F.max("gap") - F.coalesce(F.sum("length"), F.lit(0))).alias("gap"))
            # Gaps that were smaller than all open pieces of this class wait for the next ones.
            seen, old = Observation(), gaps
            gaps = written(gaps.where(F.col("gap") < least).union(rest.where("gap > 0")).observe(seen, F.max("gap").alias("largest")), f"gaps-{number}")
            largest, number = seen.get["largest"] or 0, number + 1
            dropped(old)
    dropped(gaps)
    return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY, range_rows: int = 1_000_000) -> DataFrame:
    """pieces (PIECES' columns, a table) with sequence_id and offset. range_rows: about how many pieces and places a task of a
    sweep matches."""
    n = pieces.count()
    if not n:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    # A number for each piece tells repeated rows apart. Ties of length are broken by a hash.
    known = pieces.withColumns({"row": F.monotonically_increasing_id(), "tie": F.xxhash64("doc_id", "piece", "ids_crc32", "start")})
    ranged = known.repartitionByRange(-(-n // range_rows), F.desc("length"), "tie", "row").sortWithinPartitions(F.desc("length"))
    placed = reduce(DataFrame.union, swept(written(ranged, "ranged"), capacity, range_rows))
    before = Window.partitionBy("sequence_id").orderBy("sweep", "place").rowsBetween(Window.unboundedPreceding, -1)  # `capacity` rows at most
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.withColumn("offset", offset).select(*(x.split()[0] for x in PIECES.split(", ")), "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, make_encoder=contract_encoder, end: int = 0, **options) -> DataFrame:
    """The place of every piece of every document. The tokens are counted once, into a table."""
    return pack(written(tokenized(docs, capacity, make_encoder, end), "pieces"), capacity, **options)
