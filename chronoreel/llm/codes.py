"""Vector code compression: product codes by Lloyd rounds in whole numbers, with heaps of bounds.

Vectors are cut into parts, and each part position has a codebook.  Rows are gathered into blocks where they
are read.  A block keeps, for every position and codebook entry, a heap of the parts assigned to it, keyed by
their slack: the distance to the nearest other entry less the distance to their own, plus all drift of the entry
up to then.  When entries move, a part can change only if its key is no more than its entry's drift so far, so
a round descends each heap from the top, pops just those parts, compares them with all entries and puts them
back.  Entries' sums are changed by what moved.

Distances and sums are exact: bounds only decide what is looked at again.  What leaves a task for the driver is
the sums, whose number is that of positions, entries and components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoreel.llm._io import Scratch
from chronoreel.llm._text import tidied

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and components: about 20 MB with all that belongs to it.
BLOCK, BLOCK_VALUES = 8192, 1 << 19
#: Labels whose sums may be broadcast; beyond, they are joined by a salted shuffle.
BROADCAST_LABELS = 100_000
SALTS = 32
#: Distances are square roots in double precision; keys are lowered by more than they can be off.
_OFF, _SHARE = 1e-5, 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector has components, and all of them finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def most_of(width: int) -> int:
    """Whole numbers are kept within this size, so that a squared distance of whole vectors fits 62 bits."""
    return isqrt((1 << 62) // max(1, width)) // 2


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x), kept within ``most_of``."""
    most = float(most_of(vectors.shape[1]))
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -most, most).astype(np.int64)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances: by products in doubles while these are exact, else by differences."""
    width = max(1, points.shape[1])
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * width * largest * largest < 1 << 52:
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(points), len(entries)), dtype=np.int64)
    for c in range(points.shape[1]):
        out += (points[:, c, None] - entries[None, :, c]) ** 2
    return out


def scan(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index) and slack of each point."""
    nearest, slack = np.zeros(len(points), dtype=np.uint8 if len(entries) <= 256 else np.uint16), np.full(len(points), np.inf)
    for i in range(0, len(points), 4096):
        d = squared(points[i : i + 4096], entries)
        at = np.arange(len(d))
        best = d.argmin(axis=1)
        nearest[i : i + 4096] = best
        if len(entries) > 1:
            upper = np.sqrt(d[at, best].astype(np.float64))
            d[at, best] = np.iinfo(np.int64).max
            lower = np.sqrt(d.min(axis=1).astype(np.float64))
            slack[i : i + 4096] = lower - upper - _SHARE * (lower + upper) - _OFF
    return nearest, slack


class Heaps:
    """Heaps of a block's parts at one position, one an entry, one behind the other: ``first`` has where each begins, ``row``
    and ``key`` its parts, no key below that of its parent (children of i are 2i + 1 and 2i + 2)."""

    def __init__(self, first: np.ndarray, row: np.ndarray, key: np.ndarray):
        self.first, self.row, self.key = first, row, key

    @classmethod
    def of(cls, entry: np.ndarray, key: np.ndarray, entries: int) -> Heaps:
        """Ascending runs are heaps."""
        order = np.lexsort((key, entry))
        return cls(np.searchsorted(entry[order], np.arange(entries + 1)).astype(np.int32), order.astype(np.int32), key[order])

    def pop(self, drift: np.ndarray) -> np.ndarray:
        """Rows whose key is no more than their entry's drift: all heaps are descended together, level by level, and no
        part below one that stays is looked at.  ``rest`` then has the parts that stay."""
        first, sizes = self.first[:-1].astype(np.int64), np.diff(self.first).astype(np.int64)
        heap = np.flatnonzero(sizes)
        node = np.zeros(len(heap), dtype=np.int64)
        gone = []
        while len(heap):
            at = first[heap] + node
            low = self.key[at] <= drift[heap]
            heap, node, at = heap[low], node[low], at[low]
            gone.append(at)
            heap, node = np.concatenate([heap, heap]), np.concatenate([2 * node + 1, 2 * node + 2])
            inside = node < sizes[heap]
            heap, node = heap[inside], node[inside]
        found = np.concatenate(gone) if gone else np.zeros(0, dtype=np.int64)
        stays = np.ones(len(self.row), dtype=bool)
        stays[found] = False
        self.rest = stays
        return self.row[found]

    def push(self, entry: np.ndarray, rows: np.ndarray, key: np.ndarray) -> Heaps:
        """Heaps of what stayed and of these parts; only entries that lost or gained parts are put in order again."""
        entries = len(self.first) - 1
        owner = np.repeat(np.arange(entries), np.diff(self.first))
        touched = np.zeros(entries, dtype=bool)
        touched[owner[~self.rest]] = touched[entry] = True
        again = self.rest & touched[owner]
        owners, row, keys = np.concatenate([owner[again], entry]), np.concatenate([self.row[again], rows]), np.concatenate([self.key[again], key])
        order = np.lexsort((keys, owners))
        sizes = np.where(touched, np.bincount(owners, minlength=entries), np.diff(self.first))
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        to = np.repeat(touched, sizes)
        out = Heaps(first, np.empty(len(to), dtype=np.int32), np.empty(len(to)))
        out.row[to], out.key[to] = row[order], keys[order]
        same = ~touched[owner]
        out.row[~to], out.key[~to] = self.row[same], self.key[same]
        return out


def sums_of(points: np.ndarray, entry: np.ndarray, entries: int) -> np.ndarray:
    """Componentwise sums and counts of each entry's parts: (entries, width + 1)."""
    out = np.zeros((entries, points.shape[1] + 1), dtype=np.int64)
    for c in range(points.shape[1]):
        np.add.at(out[:, c], entry, points[:, c])
    out[:, -1] = np.bincount(entry, minlength=entries)
    return out


class Codebooks:
    """Entries of each position, and how far each has drifted, with the most that another has, since the start."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.drift = np.zeros(entries.shape[:2])

    def moved(self, totals: dict[tuple[int, int, int], int]) -> Codebooks:
        """Each entry becomes the floor of its parts' mean; unused ones stay.  Totals are whole numbers of any size."""
        parts, entries, width = self.entries.shape
        fresh = self.entries.copy()
        for p in range(parts):
            for e in range(entries):
                if n := totals.get((p, e, width), 0):
                    fresh[p, e] = [totals.get((p, e, c), 0) // n for c in range(width)]
        out = Codebooks(fresh)
        step = np.sqrt(((fresh - self.entries).astype(np.float64) ** 2).sum(axis=2)) * (1 + _SHARE)
        others = np.zeros_like(step)
        if entries > 1:
            top = np.sort(step, axis=1)
            others = np.where(step == top[:, -1:], top[:, -2:-1] if entries > 1 else 0, top[:, -1:])
            ties = (step == top[:, -1:]).sum(axis=1) > 1
            others[ties] = top[ties, -1:]
        out.drift = self.drift + step + others
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


STATE = "ids binary, n int, points binary, wide boolean, codes binary, first binary, row binary, key binary, sums binary"


def _packed(points: np.ndarray) -> tuple[bytes, bool]:
    wide = bool(np.abs(points).max(initial=0) >= 1 << 15)
    return points.astype(np.int64 if wide else np.int16).tobytes(), wide


class Block:
    """A block's parts (n, positions, width), their codes and heaps."""

    def __init__(self, points: np.ndarray, codes: np.ndarray, heaps: list[Heaps]):
        self.points, self.codes, self.heaps = points, codes, heaps

    @classmethod
    def fresh(cls, points: np.ndarray, books: Codebooks) -> tuple[Block, np.ndarray]:
        """Every part compared with every entry; and the entries' sums."""
        n, parts, _ = points.shape
        entries = books.entries.shape[1]
        codes, heaps, sums = np.zeros((n, parts), dtype=np.uint8 if entries <= 256 else np.uint16), [], []
        for p in range(parts):
            codes[:, p], slack = scan(points[:, p], books.entries[p])
            heaps.append(Heaps.of(codes[:, p], slack + books.drift[p][codes[:, p]], entries))
            sums.append(sums_of(points[:, p], codes[:, p], entries))
        return cls(points, codes, heaps), np.stack(sums)

    def advance(self, books: Codebooks) -> np.ndarray:
        """Pops what drift may have changed, compares it anew and pushes it; returns the change of the entries' sums."""
        entries, sums = books.entries.shape[1], []
        for p, heaps in enumerate(self.heaps):
            rows = heaps.pop(books.drift[p])
            points = self.points[rows, p]
            found, slack = scan(points, books.entries[p])
            before = self.codes[rows, p]
            changed = before != found
            sums.append(sums_of(points[changed], found[changed], entries) - sums_of(points[changed], before[changed], entries))
            self.codes[rows, p] = found
            self.heaps[p] = heaps.push(found, rows, slack + books.drift[p][found])
        return np.stack(sums)

    def errors(self, books: Codebooks) -> np.ndarray:
        """Squared distances to the assigned entries, summed over positions."""
        out = np.zeros(len(self.points), dtype=np.int64)
        for p in range(self.points.shape[1]):
            out += ((self.points[:, p] - books.entries[p][self.codes[:, p]]) ** 2).sum(axis=1)
        return out

    def record(self, ids: bytes, sums: np.ndarray) -> list:
        points, wide = _packed(self.points)
        join = lambda name: b"".join(np.ascontiguousarray(getattr(h, name)).tobytes() for h in self.heaps)
        return [ids, len(self.points), points, wide, self.codes.astype("<u2").tobytes(), join("first"), join("row"), join("key"), sums.astype("<i8").tobytes()]

    @classmethod
    def read(cls, r: dict, books: Codebooks) -> Block:
        parts, entries, width = books.entries.shape
        n = r["n"]
        points = np.frombuffer(r["points"], dtype=np.int64 if r["wide"] else np.int16).astype(np.int64).reshape(n, parts, width)
        codes = np.frombuffer(r["codes"], dtype="<u2").reshape(n, parts).copy()
        first, row, key = (np.frombuffer(r[c], dtype=t).reshape(parts, -1) for c, t in (("first", np.int32), ("row", np.int32), ("key", np.float64)))
        return cls(points, codes, [Heaps(first[p], row[p], key[p]) for p in range(parts)])


def _columns(rows: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


_FIELDS = [("ids", pa.binary()), ("n", pa.int32()), ("points", pa.binary()), ("wide", pa.bool_()), *((c, pa.binary()) for c in ("codes", "first", "row", "key", "sums"))]


def _ids(columns: list[pa.Array]) -> bytes:
    """Keys and labels of a block as an Arrow stream, whatever their types."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(columns, ["key", "label"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _totals(table: DataFrame, shape: tuple[int, int, int]) -> dict[tuple[int, int, int], int]:
    """Sums over all blocks: a task adds up its blocks, then a group is one component of one entry."""
    parts, entries, width = shape

    @tidied
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(parts * entries * (width + 1), dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                held += np.frombuffer(x.as_buffer(), dtype="<i8")
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["at", "x"])

    rows = table.select("sums").mapInArrow(work, "at long, x long").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    return {(r["at"] // (width + 1) // entries, r["at"] // (width + 1) % entries, r["at"] % (width + 1)): int(r["x"]) for r in rows}


def encode(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK
) -> tuple[DataFrame, Codebooks | None]:
    """((key, label, codes, error), codebooks): ``codes`` is an array of entry numbers and ``error`` the squared distance.

    Rows whose vector is null or empty, or holds null or non-finite components, are left out, as are vectors of another
    length than the first kept one's (that of the smallest key).  A length that ``parts`` doesn't divide is filled
    up with zeros.  Components beyond ``most_of`` after scaling count as that.  Codebooks start as the ``entries``
    kept rows of the smallest non-null keys (then by vector), or as many as there are; repeated rows count each.  A
    null key is coded like any other.  Without a non-null key among the kept rows there is no codebook, and no row.
    """
    scratch = Scratch(df.sparkSession, "codes")
    kept = df.where(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    first = kept.where("key is not null").orderBy("key", "v").limit(entries).collect()
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(label, df.schema[label].dataType), *T._parse_datatype_string("codes array<int>, error long")])
    if not first:
        return df.sparkSession.createDataFrame([], out), None
    length = len(first[0].v)
    kept = kept.where(F.size("v") == length)
    width = -(-length // parts)
    if any(len(r.v) != length for r in first):
        first = kept.where("key is not null").orderBy("key", "v").limit(entries).collect()

    def cut(vectors: np.ndarray) -> np.ndarray:
        filled = np.zeros((len(vectors), parts * width), dtype=np.int64)
        filled[:, :length] = whole(vectors, scale)
        return filled.reshape(-1, parts, width)

    books = Codebooks(np.ascontiguousarray(cut(np.array([r.v for r in first])).transpose(1, 0, 2)))
    rows = max(1, min(block, BLOCK_VALUES // (parts * width)))

    def start(books: Codebooks):
        @tidied
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def made() -> pa.RecordBatch:
                columns = [pa.concat_arrays([b.column(c) for b in held]) for c in (0, 1)]
                values = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, length) for b in held])
                fresh, sums = Block.fresh(cut(values), books)
                return _columns([fresh.record(_ids(columns), sums)], _FIELDS)

            for batch in batches:
                while batch.num_rows:
                    part = batch.slice(0, rows - n)
                    held.append(part)
                    n += part.num_rows
                    batch = batch.slice(part.num_rows)
                    if n == rows:
                        yield made()
                        held, n = [], 0
            if n:
                yield made()

        return work

    def advance(books: Codebooks):
        @tidied
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    b = Block.read(r, books)
                    yield _columns([b.record(r["ids"], b.advance(books))], _FIELDS)

        return work

    def finish(books: Codebooks):
        @tidied
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    b = Block.read(r, books)
                    b.advance(books)
                    ids = pa.ipc.open_stream(r["ids"]).read_all().combine_chunks()
                    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in ids.columns]
                    codes = pa.ListArray.from_arrays(pa.array(np.arange(0, parts * r["n"] + 1, parts), pa.int32()), pa.array(b.codes.reshape(-1).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*columns, codes, pa.array(b.errors(books))], [f.name for f in out.fields])

        return work

    state = scratch.save(kept.mapInArrow(start(books), STATE), "assigned")
    totals = _totals(state, books.entries.shape)
    for i in range(rounds):
        books = books.moved(totals)
        if i + 1 == rounds:
            break
        before, state = state, scratch.save(state.mapInArrow(advance(books), STATE), "assigned")
        scratch.drop(before)
        for at, x in _totals(state, books.entries.shape).items():
            totals[at] = totals.get(at, 0) + x
    final = scratch.save(state.mapInArrow(finish(books), out), "codes")
    scratch.drop(state)
    return final, books


def label_sums(rows: DataFrame, label: str, value: str, key: str, name: str) -> DataFrame:
    """``rows`` with ``value`` summed over equal labels, nulls together.  Sums are made where rows are, then joined: broadcast
    up to BROADCAST_LABELS, else with salted labels, so that no label's rows meet in one task.  A sum beyond a long is
    null."""
    total = F.sum(F.col(value).cast("decimal(38,0)")).try_cast("long").alias(name)
    sums = rows.groupBy(F.col(label).alias("of")).agg(total)
    if sums.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("of"))).drop("of")
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("row_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col(label).eqNullSafe(F.col("of")) & (F.col("row_salt") == F.col("salt"))).drop("of", "salt", "row_salt")


def op12_codes(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """Contract columns for ``embeddings``."""
    coded, books = encode(embeddings)
    digest = books.digest() if books else hashlib.sha256(b"").hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    summed = label_sums(coded, "label", "error", "vec_id", "label_error")
    return summed.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
