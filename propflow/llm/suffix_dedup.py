"""Repeated byte strings removed from texts, found by a distributed difference-cover suffix order.

Positions 1 and 2 modulo 3 are the cover. Their triples of 32-byte symbols are sorted across the
cluster and named by rank, so names order the first 96 bytes of every cover suffix. A remaining
suffix is its first bytes and a cover suffix; any two positions reach the cover together after 0, 1
or 2 bytes, so three sorted lists hold every pair that can be equal. Each list is sorted by 100-byte
prefix and place, and a row whose prefix is its predecessor's is a repeat.

Before that, bytes that need no sorting are set aside. Exact copies of texts go first. Every
100-byte string holds the least 72-byte gram of its window, so a gram that occurs once repeats
nothing. Where the bytes around a gram, as far as its windows reach, occur a second time, all of the
windows do: the later ones are runs, and the first stays in the sort only if its gram also occurs
between other bytes and the window's hash occurs again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from propflow.llm.bits import Bits, bitmap
from propflow.llm.hashing import mix, prefix_sums, span_hashes, text_slices
from propflow.operators.ordering import rank_in_group
from propflow.session import materialize

LENGTH = 100
GRAM = 72
MARGIN = LENGTH - GRAM
SYMBOL = 32  # bytes of a symbol
NAMED = 3 * SYMBOL  # bytes that a name covers
POOL = 2 << 20  # hashes counted at a time in a task
BATCH = 1 << 16  # rows handed over at a time
BUCKETS, REST = 10, 32  # bits of a hash that are its bucket, and that are kept beside it
BITS = 26  # least size of a bitmap, as a power of two: 8 MB
SENT = 1 << 21  # most numbers in a table that is sent to every task

SPOT = ["doc", "sub"]  # a text: the least id of its copies, and its rank among texts that share it
CONTEXTS = "h bigint, k bigint, doc bigint, sub bigint, place bigint"
LISTED = "a bigint, b bigint, c bigint, doc bigint, sub bigint, start bigint"


def _slid(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """`least` of each `width` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        values = least(values[:-done], values[done:])
        done *= 2
    return least(values[: len(values) - (width - done)], values[width - done :])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, offsets from 0, bytes) of the runs of rows that hold a window."""
    for at, offsets, data in text_slices(batch.column(column)):
        if len(data) >= LENGTH:
            yield slice(at, at + len(offsets) - 1), offsets, data


def _windows(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums, hashes of all grams, and the least hash of each window; 0 for windows that cross texts."""
    sums = prefix_sums(data)
    starts = np.arange(len(data) - GRAM + 1)
    hashed = span_hashes(sums, starts, starts + GRAM)
    least = _slid(hashed, MARGIN + 1, np.minimum)
    crossing = np.zeros(len(least) + 1, dtype=np.int64)
    ends = offsets[1:-1]
    np.add.at(crossing, np.minimum(np.maximum(ends - LENGTH + 1, 0), len(least)), 1)
    np.add.at(crossing, np.minimum(ends, len(least)), -1)
    least[np.cumsum(crossing)[:-1] > 0] = 0
    return sums, hashed, least


def least_grams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are least in some window of LENGTH bytes of a text.

    Least hashes lie low, so they are mixed once more: their leading bits tell buckets and cells.
    """
    _, hashed, least = _windows(offsets, data)
    none = np.zeros(MARGIN, dtype=np.uint64)
    most = _slid(np.concatenate([none, least, none]), MARGIN + 1, np.maximum)
    places = np.flatnonzero((most == hashed) & (most > 0))
    return places, mix(hashed[places])


def _bytes(value) -> np.ndarray:
    return np.frombuffer((value.as_py() or "").encode(), dtype=np.uint8)


def _binaries(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings from the bytes of all and where each ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _handed(columns: list, names: list[str]):
    """Long rows in batches."""
    for at in range(0, len(columns[0]), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + BATCH]) for c in columns], names)


def _packed(hashes: Iterable[np.ndarray]):
    """(bucket, once, often): the distinct hashes of each pool by their leading bits, the next 32 bits of each."""

    def counted(pool):
        every, counts = np.unique(np.concatenate(pool) >> np.uint64(64 - BUCKETS - REST), return_counts=True)
        columns = [pa.array(np.arange(1 << BUCKETS, dtype=np.int32))]
        for part in (every[counts == 1], every[counts > 1]):
            ends = np.searchsorted(part >> np.uint64(REST), np.arange(1 << BUCKETS), side="right")
            columns.append(_binaries(part.astype(np.uint32), 4 * ends))
        return pa.RecordBatch.from_arrays(columns, ["bucket", "once", "often"])

    pool, held = [], 0
    for some in hashes:
        pool.append(some)
        held += len(some)
        if held >= POOL:
            yield counted(pool)
            pool, held = [], 0
    if held:
        yield counted(pool)


def _often(rows: pa.Table) -> pa.Table:
    """Of a bucket, the hashes (h) that occur more than once."""
    once, often = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=np.uint32) for c in ("once", "often"))
    every, counts = np.unique(once, return_counts=True)
    bucket = np.uint64(rows.column("bucket")[0].as_py())
    found = np.union1d(every[counts > 1], often).astype(np.uint64) | bucket << np.uint64(REST)
    return pa.table({"h": (found << np.uint64(64 - BUCKETS - REST)).view(np.int64)})


def _repeated(packed: DataFrame) -> Broadcast:
    """The hashes that occur more than once, as a bitmap that may say yes to others too."""
    often = packed.groupBy("bucket").applyInArrow(_often, "h bigint")
    return packed.sparkSession.sparkContext.broadcast(bitmap(materialize(often), least=BITS))


def _grams(batches):
    return _packed(least_grams(o, d)[1] for batch in batches for _, o, d in _slices(batch, "text"))


def _contexts(batches, repeated: Bits):
    """(h, k, doc, sub, place): the grams that may be repeated, with a hash of all bytes that their windows reach."""
    for batch in batches:
        for rows, offsets, data in _slices(batch, "text"):
            places, hashed = least_grams(offsets, data)
            kept = repeated.has(hashed)
            places, hashed = places[kept], hashed[kept]
            row = np.searchsorted(offsets, places, side="right") - 1
            raw = data.tobytes()
            lows = np.maximum(places - MARGIN, offsets[row])
            highs = np.minimum(places + LENGTH, offsets[row + 1])
            keys = b"".join(
                hashlib.blake2b(raw[low:high], digest_size=8, salt=bytes([p - low])).digest()
                for low, p, high in zip(lows.tolist(), places.tolist(), highs.tolist(), strict=True)
            )
            spot = [batch.column(c).to_numpy()[rows][row] for c in SPOT]
            columns = [hashed.view(np.int64), np.frombuffer(keys, dtype=np.int64), *spot, places - offsets[row]]
            yield from _handed(columns, ["h", "k", *SPOT, "place"])


def _compared(batches, keys: int, firsts: bool):
    """Rows of a sorted partition with their kind.

    Kind 0 has its predecessor's key, kind 1 has not and comes only if `firsts`; 2 is the partition's
    first row and 3 its last, which comes once more. Only these two carry their whole key, kind 1
    its first column. Rows that are their predecessor's equal in all columns are left out.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        rows = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        differs = np.ones(rows.shape, dtype=bool)
        differs[1:] = rows[1:] != rows[:-1]
        if last is not None:
            differs[0] = rows[0] != last
        kind = differs[:, :keys].any(axis=1).astype(np.int8)
        if last is None:
            kind[0] = 2
        last = rows[-1]
        kept = differs.any(axis=1) & (firsts | (kind != 1))
        rows, kind = rows[kept], kind[kept]
        masks = [kind == 0] + [kind < 2] * (keys - 1) + [None] * (len(names) - keys)
        yield from _handed([pa.array(c, mask=m) for c, m in zip(rows.T, masks, strict=True)] + [pa.array(kind)], [*names, "kind"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([x]) for x in last.tolist()), pa.array([3], pa.int8())], [*names, "kind"])


def _told(rows: DataFrame, keys: int, schema: str, firsts: bool = False) -> DataFrame:
    """Rows with `later`: whether an equal key comes before in the order of all columns.

    Rows are sorted in ranges of all columns, so a key that very many rows share spreads over ranges;
    the first and the last row of each tell whether a key goes on.
    """
    order = rows.columns
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = placed.mapInArrow(lambda b: _compared(b, keys, firsts), f"{schema}, kind tinyint")
    found = materialize(found.withColumn("part", F.spark_partition_id()))
    ends = found.where("kind > 1").collect()  # two rows per partition
    starts, lasts = ({r.part: tuple(r)[:keys] for r in ends if r.kind == k} for k in (2, 3))
    parts = sorted(starts)
    across = [q for p, q in zip(parts, parts[1:], strict=False) if starts[q] == lasts[p]]
    goes_on = F.col("part").isin(across) if across else F.lit(False)
    later = (F.col("kind") == 0) | ((F.col("kind") == 2) & goes_on)
    return found.where("kind < 3").withColumn("later", later).drop("kind", "part")


def _pieces(batches):
    """(doc, sub, at, data, places): the stretches of a text that the windows of its places reach."""
    for batch in batches:
        docs, subs, starts, parts, inside = [], [], [], [], []
        for doc, sub, text, places in zip(*(batch.column(c) for c in (*SPOT, "text", "places")), strict=True):
            raw, places = text.as_py().encode(), np.unique(places.values.to_numpy())
            low = np.maximum(places - MARGIN, 0)
            high = np.minimum(places + LENGTH, len(raw))
            new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
            ends = np.append(new[1:], len(places)) - 1
            docs += [doc.as_py()] * len(new)
            subs += [sub.as_py()] * len(new)
            starts += low[new].tolist()
            parts += [raw[a:b] for a, b in zip(low[new].tolist(), high[ends].tolist(), strict=True)]
            inside += [(places[a : b + 1] - low[a]).astype(np.int32) for a, b in zip(new.tolist(), ends.tolist(), strict=True)]
        columns = [pa.array(docs, pa.int64()), pa.array(subs, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary()), pa.array(inside, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, [*SPOT, "at", "data", "places"])


def _open_windows(batch: pa.RecordBatch):
    """(rows, offsets, bytes, windows, their hashes) of pieces: the windows in which a gram of `places` is least."""
    lists = batch.column("places")
    counts = np.array([len(p) for p in lists], dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])
    every = lists.flatten().to_numpy()
    for rows, offsets, data in _slices(batch, "data"):
        sums, hashed, least = _windows(offsets, data)
        own = np.full(len(hashed), np.iinfo(np.uint64).max)
        places = every[before[rows.start] : before[rows.stop]] + np.repeat(offsets[:-1], counts[rows])
        own[places] = hashed[places]
        windows = np.flatnonzero(_slid(own, MARGIN + 1, np.minimum) == least)
        yield rows, offsets, data, windows, span_hashes(sums, windows, windows + LENGTH)


def _window_hashes(batches):
    return _packed(hashed for batch in batches for *_, hashed in _open_windows(batch))


def _triples(batches, repeated: Bits):
    """(key, doc, sub, place, around): cover triples at 0, 1 or 2 bytes from windows that may be repeated.

    `around` holds two bytes before the triple and four after it, and three bits that tell from which
    windows. Neighbours in a task's rows are alike, which keeps the shuffled rows small.
    """
    for batch in batches:
        for rows, offsets, data, windows, hashed in _open_windows(batch):
            windows = windows[repeated.has(hashed)]
            row = np.searchsorted(offsets, windows, side="right") - 1
            from_text = batch.column("at").to_numpy()[rows] - offsets[:-1]
            owner = np.zeros(len(data), dtype=np.int64)
            shifts = np.zeros(len(data), dtype=np.int64)
            for shift in range(3):
                covered = (windows + from_text[row] + shift) % 3 != 0
                owner[windows[covered] + shift] = row[covered]
                shifts[windows[covered] + shift] |= 1 << shift
            place = np.flatnonzero(shifts)
            if not len(place):
                continue
            keys = np.lib.stride_tricks.sliding_window_view(data, NAMED)[place]
            order = np.argsort(keys.view(f"S{NAMED}").ravel(), kind="stable")
            place, keys = place[order], keys[order]
            around = np.zeros(len(place), dtype=np.int64)
            for k in (-2, -1, *range(NAMED, LENGTH)):
                around = around << 8 | data[np.clip(place + k, 0, len(data) - 1)]
            owner = owner[place]
            columns = [*(batch.column(c).to_numpy()[rows][owner] for c in SPOT), place + from_text[owner], around << 3 | shifts[place]]
            key = _binaries(keys.ravel(), np.arange(1, len(place) + 1) * NAMED)
            yield from _handed([key, *columns], ["key", *SPOT, "place", "around"])


def _ranked(batches):
    """Dense ranks within a sorted partition; equal neighbours share one.

    Names that a single row has are counted and left out. The partition's first row keeps its key and
    the last row comes once more with its own, without a place.
    """
    before, rank = None, -1
    names = ["r", *SPOT, "place", "around", "key"]
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=np.uint8).reshape(-1, NAMED)
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        new[0] = before is None or (keys[0] != before).any()
        kept = ~(new & np.append(new[1:], False))
        ranks = rank + np.cumsum(new)
        told = np.zeros(len(keys), dtype=bool)
        if before is None:
            kept[0] = told[0] = True
        before, rank = keys[-1], int(ranks[-1])
        first = [keys[0].tobytes() if t else None for t in told[kept][:1]] + [None] * (int(kept.sum()) - 1)
        columns = [ranks[kept], *(batch.column(c).to_numpy()[kept] for c in names[1:-1]), pa.array(first[: int(kept.sum())], pa.binary())]
        yield from _handed(columns, names)
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rank]), *[pa.array([None], pa.int64())] * 4, pa.array([before.tobytes()])], names)


def name_triples(rows: DataFrame) -> DataFrame:
    """(name, doc, sub, place, around): the rank of each row's key among all distinct keys, where rows share it.

    Rows are sorted in ranges of (key, place), so a key that very many rows share spreads over
    ranges; the ranges' first and last keys, one row each, tell where a rank goes on.
    """
    sorted_rows = rows.repartitionByRange("key", *SPOT, "place").sortWithinPartitions("key")
    ranked = sorted_rows.mapInArrow(_ranked, "r bigint, doc bigint, sub bigint, place bigint, around bigint, key binary")
    ranked = materialize(ranked.withColumn("part", F.spark_partition_id()))
    edges = ranked.where("key is not null").select("part", "place", "key", "r").collect()  # two rows per partition
    low, high = ({e.part: e for e in edges if (e.place is None) == end} for end in (False, True))
    offsets, total, last = [], 0, None
    for part in sorted(low):
        total -= low[part].key == last
        offsets.append((part, total))
        total, last = total + high[part].r + 1, high[part].key
    ranked = ranked.where("place is not null")
    if not offsets:
        return ranked.select(F.col("r").alias("name"), *SPOT, "place", "around")
    table = rows.sparkSession.createDataFrame(offsets, "part int, ahead bigint")
    return ranked.join(F.broadcast(table), "part").select((F.col("r") + F.col("ahead")).alias("name"), *SPOT, "place", "around")


def _suffixes(batches):
    """(a, b, c, doc, sub, start): each 100-byte string in the lists of the shifts after which it meets the cover.

    List s compares s bytes (a), a name of 96 bytes and the bytes still missing (c).
    """
    names = ["a", "b", "c", *SPOT, "start"]
    for batch in batches:
        name, doc, sub, place, around = (batch.column(c).to_numpy() for c in ("name", *SPOT, "place", "around"))
        for shift in range(3):
            has = np.flatnonzero(around >> shift & 1)
            # shift 0 joins residues 1 and 2, 1 joins 0 and 1, 2 joins 0 and 2
            edges = around[has] >> 3
            ahead = (edges >> 32) & ((1 << 8 * shift) - 1)
            behind = (edges & 0xFFFFFFFF) >> 8 * shift
            yield from _handed([shift << 16 | ahead, name[has], behind, doc[has], sub[has], place[has] - shift], names)


def _sorted_repeats(pieces: DataFrame) -> DataFrame:
    """(doc, sub, start): the 100-byte strings of the pieces (doc, sub, at, data, places) that also start earlier."""
    repeated = _repeated(pieces.mapInArrow(_window_hashes, "bucket int, once binary, often binary"))
    triples = pieces.mapInArrow(lambda b: _triples(b, repeated.value), "key binary, doc bigint, sub bigint, place bigint, around bigint")
    lists = name_triples(triples).mapInArrow(_suffixes, LISTED)
    return _told(lists, 3, LISTED).where("later").select(*SPOT, "start")


def _sent(df: DataFrame, numbers: int) -> DataFrame:
    """The table, sent to every task as long as it is small."""
    return F.broadcast(df) if numbers <= SENT else df


def repeated_strings(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc, sub, start) of strings that also start earlier, (doc, sub, place) of grams all of whose windows do).

    `reps` (doc, sub, text) are texts in the order in which they count as earlier; rows equal in doc
    and sub are one text.
    """
    repeated = _repeated(reps.select("text").mapInArrow(_grams, "bucket int, once binary, often binary"))
    contexts = _told(reps.mapInArrow(lambda b: _contexts(b, repeated.value), CONTEXTS), 2, CONTEXTS, firsts=True)
    first = contexts.where("not later").select("h", *SPOT, "place")
    several = first.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    places = first.join(several, "h", "left_semi").groupBy(F.col("doc").alias("_doc"), F.col("sub").alias("_sub")).agg(F.collect_list("place").alias("places"))
    places = materialize(places)
    marked = reps.join(_sent(places, _numbers(places, "places")), (F.col("doc") == F.col("_doc")) & (F.col("sub") == F.col("_sub")))
    pieces = marked.select(*SPOT, "text", "places").mapInArrow(_pieces, "doc bigint, sub bigint, at bigint, data binary, places array<int>")
    return _sorted_repeats(materialize(pieces)), contexts.where("later").select(*SPOT, "place")


def _numbers(df: DataFrame, column: str) -> int:
    """How many numbers the lists of a column hold, and how many rows there are."""
    row = df.agg(F.sum(F.size(column)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    return (row.n or 0) + row.rows


def _merged(batches):
    """(doc, sub, starts, ends): the runs that spans leave together."""
    for batch in batches:
        starts, ends = [], []
        for lows, highs in zip(batch.column("lows"), batch.column("highs"), strict=True):
            low, high = lows.values.to_numpy(), highs.values.to_numpy()
            order = np.argsort(low, kind="stable")
            low, high = low[order], np.maximum.accumulate(high[order])
            new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
            starts.append(low[new])
            ends.append(high[np.append(new[1:], len(low)) - 1])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in SPOT), pa.array(starts, kind), pa.array(ends, kind)], [*SPOT, "starts", "ends"])


def _removed(batches):
    for batch in batches:
        out = []
        for text, starts, ends, copy in zip(*(batch.column(c) for c in ("text", "starts", "ends", "copy")), strict=True):
            data = _bytes(text)
            gone = np.zeros(len(data) + 1, dtype=np.int64)
            if copy.as_py() and len(data) >= LENGTH:
                gone[0], gone[-1] = 1, -1
            if starts.is_valid:
                np.add.at(gone, starts.values.to_numpy(), 1)
                np.add.at(gone, np.minimum(ends.values.to_numpy(), len(data)), -1)
            cover = np.cumsum(gone)[:-1] > 0
            edges = np.diff(np.concatenate([[False], cover]).astype(np.int8)) == 1
            out.append((len(data), int(cover.sum()), int(edges.sum()), hashlib.sha256(data[~cover].tobytes()).hexdigest()))
        n, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc, sub, copy): each row's text in the order of texts, and whether an earlier row holds it.

    Only texts that have copies, or share their id with another, are looked up; the others are their own.
    """
    keyed = docs.withColumn("key", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    keyed = keyed.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    first = materialize(keyed.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    shared = first.groupBy("first").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("first")
    shared = rank_in_group(first.join(shared, "first", "left_semi").select("first", "key"), ["first"], ["key"], out="sub")
    special = first.where("n > 1").select("key", "first", F.lit(0).cast("long").alias("sub"))
    special = special.unionByName(shared.select("key", "first", F.col("sub").cast("long").alias("sub")))
    special = materialize(special.groupBy(F.col("key").alias("_key")).agg(F.min("first").alias("first"), F.max("sub").alias("sub")))
    numbers = 6 * special.count()
    joined = keyed.join(_sent(special, numbers), F.col("key") == F.col("_key"), "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    marked = joined.select("doc_id", "text", F.coalesce("first", "id").alias("doc"), F.coalesce("sub", zero).alias("sub"), F.coalesce(F.col("id") > F.col("first"), no).alias("copy"))
    return marked if numbers <= SENT else materialize(marked)  # texts move once, not in each scan


def removal_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Null texts are empty. Of equal texts the one with the smallest id goes on, the others are
    removed whole if they hold a string of that length at all. Null ids count as the smallest; rows
    equal in id and text count as one document. Texts are told apart by their place in the order of
    (id, text hash), so rows that share an id or have none stay apart.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = _told_apart(docs)
    starts, places = repeated_strings(marked.where("not copy").select(*SPOT, "text"))
    spans = starts.select(*SPOT, F.col("start").alias("low"), (F.col("start") + LENGTH).alias("high"))
    spans = spans.unionByName(places.select(*SPOT, F.greatest(F.col("place") - MARGIN, F.lit(0)).alias("low"), (F.col("place") + LENGTH).alias("high")))
    spans = spans.groupBy(*SPOT).agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    runs = materialize(spans.mapInArrow(_merged, "doc bigint, sub bigint, starts array<bigint>, ends array<bigint>"))
    runs = _sent(runs, 2 * _numbers(runs, "starts")).withColumnsRenamed({"doc": "_doc", "sub": "_sub"})
    same = (F.col("doc") == F.col("_doc")) & (F.col("sub") == F.col("_sub")) & ~F.col("copy")
    return marked.join(runs, same, "left").select("doc_id", "text", "starts", "ends", "copy").mapInArrow(
        _removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
