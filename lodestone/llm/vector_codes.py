"""Vector compression by one small codebook per part, trained with norm-of-sum bounds.

Components become integers, so every distance is exact.  A vector is cut into
``parts`` equal parts; a part is held as the index of its codebook's nearest
entry (squared Euclidean distance, ties to the lower index).  Each round assigns
all parts, then moves each entry to the floored mean of its parts.

Between rounds a part keeps the index of its entry and two bounds, each with the
round that it was computed in: ``upper`` on the distance to its own entry and
``lower`` on that to any other.  The driver keeps every codebook since the
start.  A bound of round s is carried to round t by the true displacement
between the codebooks of s and t, the norm of the summed moves: an entry that
went and came back costs nothing, where the sum of its single moves would have
eaten the bound.  For ``lower`` this is the largest displacement of the other
entries.  Only parts whose carried bounds do not decide are looked at again,
first against their own entry alone, then against all.  Bounds are rounded
outwards and must decide strictly, so ties and results are those of the full
search.

A round is one pass: tasks read rows with their state, write them with the new
one, and add one row per part and entry with the change of its sum and count.
These rows (``parts * entries`` per task) are summed by Spark, and as many
numbers reach the driver.  The round before is then deleted.  Each pass begins
from a written table, so a lost executor repeats its tasks of one round.

Null vectors and vectors with null or non-finite components are dropped.  All
others count with the greatest length, rounded up to a multiple of ``parts``:
shorter ones are filled with zeros.  Integers must stay within 2^29 (components
within 2^17), beyond which squared distances leave 64 bits: an error, not a
wrong code.  The first codebook comes from the smallest ids, nulls last; equal
ids are ordered by their components.  With fewer rows there are fewer entries.
Repeated rows count as often as they occur.  A null label is a label.  An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checked_broadcast, dropped, stored_at

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
GREATEST = 1 << 29
#: bounds are kept as 32-bit floats, moved outwards by more than their rounding
SLACK = 1e-6
STATE = [("entry", "u1"), ("upper_round", "u1"), ("lower_round", "u1"), ("upper", "<f4"), ("lower", "<f4")]

ROWS = "vec_id bigint, label int, vector binary, state binary, error bigint, part int, entry int, n bigint, total array<bigint>"
ARROW = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.int32()), ("vector", pa.binary()), ("state", pa.binary()), ("error", pa.int64())]
    + [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]
)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(wrong, F.lit(False))


class Search:
    """Nearest entries of blocks of parts under the newest codebook, by bounds under older ones.

    ``history[t]`` is the codebook of round t: integers, parts x entries x width.
    """

    def __init__(self, history: list[np.ndarray]):
        self.now = len(history) - 1
        self.book = history[-1]
        self.rescans = self.looks = 0
        old = np.stack(history).astype(np.float64)
        moved = np.sqrt(((old - old[-1]) ** 2).sum(axis=-1)) * (1 + SLACK)
        self.moved = moved
        # the largest displacement of the entries other than each one
        parts, entries = moved.shape[1:]
        self.others = np.zeros_like(moved)
        if entries > 1:
            order = np.argsort(moved, axis=-1)
            top = np.take_along_axis(moved, order[..., -1:], -1)
            second = np.take_along_axis(moved, order[..., -2:-1], -1)
            self.others = np.where(np.arange(entries) == order[..., -1:], second, top)

    def start(self, vectors: np.ndarray) -> np.ndarray:
        """The state of parts never seen: no bound decides anything."""
        state = np.zeros(vectors.shape[:2], STATE)
        state["upper"], state["lower"] = np.inf, 0.0
        return state

    def _squared(self, vectors: np.ndarray, row: np.ndarray, part: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((vectors[row, part] - self.book[part, entry]) ** 2).sum(axis=-1)

    def assign(self, vectors: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The state after this round; ``vectors`` is rows x parts x width."""
        state = state.copy()
        parts = np.arange(vectors.shape[1])
        upper = state["upper"] + self.moved[state["upper_round"], parts, state["entry"]]
        lower = state["lower"] - self.others[state["lower_round"], parts, state["entry"]]
        row, part = np.nonzero(~(upper < lower))
        self.looks += len(row)
        # their own entry first: the exact distance often falls under the other bound
        near = np.sqrt(self._squared(vectors, row, part, state["entry"][row, part]).astype(np.float64)) * (1 + SLACK)
        state["upper"][row, part], state["upper_round"][row, part] = near * (1 + SLACK), self.now
        rest = ~(state["upper"][row, part] < lower[row, part])
        row, part = row[rest], part[rest]
        self.rescans += len(row)
        every = ((vectors[row, part][:, None, :] - self.book[part]) ** 2).sum(axis=-1)
        best = every.argmin(axis=1)
        at = np.arange(len(row))
        state["entry"][row, part] = best
        state["upper"][row, part] = np.sqrt(every[at, best].astype(np.float64)) * (1 + SLACK)
        if every.shape[1] > 1:
            every[at, best] = np.iinfo(np.int64).max
            state["lower"][row, part] = np.sqrt(every.min(axis=1).astype(np.float64)) * (1 - SLACK)
        else:
            state["lower"][row, part] = np.inf
        state["lower_round"][row, part] = self.now
        return state

    def errors(self, vectors: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """The summed squared distance of each vector to the entries of its code."""
        return ((vectors - self.book[np.arange(vectors.shape[1]), entry]) ** 2).sum(axis=(1, 2))


def _blobs(column: pa.Array, kind) -> np.ndarray:
    """Rows of equally long binaries as one array of ``kind``."""
    return np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in column]) if len(column) else np.zeros(0, kind)


def _integers(column: pa.Array, parts: int, width: int, scale: int) -> np.ndarray:
    """rows x parts x width of floor(scale * component), short vectors filled with zeros."""
    out = np.zeros((len(column), parts * width))
    lengths = np.diff(column.offsets.to_numpy())
    out[np.arange(parts * width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out = np.floor(out * scale)
    if out.size and np.abs(out).max() > GREATEST:
        raise ValueError(f"a component is beyond {GREATEST // scale}: its distances would leave 64 bits")
    return out.astype(np.int64).reshape(len(column), parts, width)


def _summed(sums: np.ndarray, counts: np.ndarray, vectors: np.ndarray, entry: np.ndarray, sign: int) -> None:
    """Add (or take away) the parts of these entries; arrays are by part and entry."""
    parts = np.broadcast_to(np.arange(vectors.shape[1]), entry.shape)
    np.add.at(sums, (parts, entry), sign * vectors)
    np.add.at(counts, (parts, entry), sign)


def _round(batches: Iterator[pa.RecordBatch], history: list[np.ndarray], scale: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Assign the parts of each row; last, the change of each entry's sum and count."""
    search = Search(history)
    parts, entries, width = search.book.shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        if search.now == 0:
            vectors = _integers(batch.column("embedding"), parts, width, scale)
            state = search.assign(vectors, search.start(vectors))
            _summed(sums, counts, vectors, state["entry"], 1)
        else:
            vectors = _blobs(batch.column("vector"), "<i4").astype(np.int64).reshape(rows, parts, width)
            before = _blobs(batch.column("state"), STATE).reshape(rows, parts)
            state = search.assign(vectors, before)
            # a row whose code is as before changes no sum; moved parts leave one entry and join another
            went = (state["entry"] != before["entry"]).any(axis=1)
            _summed(sums, counts, vectors[went], before["entry"][went], -1)
            _summed(sums, counts, vectors[went], state["entry"][went], 1)
        held = [pa.array([x.tobytes() for x in a], pa.binary()) for a in (vectors.astype("<i4"), state)]
        errors = pa.array(search.errors(vectors, state["entry"])) if last else pa.nulls(rows, pa.int64())
        blank = [pa.nulls(rows, ARROW.field(k).type) for k in ("part", "entry", "n", "total")]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *held, errors, *blank], schema=ARROW)
    part, entry = (a.ravel() for a in np.indices(counts.shape))
    blank = [pa.nulls(parts * entries, ARROW.field(k).type) for k in ("vec_id", "label", "vector", "state", "error")]
    own = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts.ravel()), pa.array(sums.reshape(-1, width).tolist(), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays([*blank, *own], schema=ARROW)


def _start(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The first codebook, parts x entries x width; None where there are no rows."""
    size = rows.agg(F.max(F.size("embedding"))).first()[0]
    if size is None:
        return None
    width = -(-size // parts)
    whole = F.transform("embedding", lambda x: F.floor(x * scale))
    first = rows.select("vec_id", whole.alias("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    book = np.zeros((len(first), parts * width), np.int64)
    for k, row in enumerate(first):
        book[k, : len(row.v)] = row.v
    return book.reshape(len(first), parts, width).transpose(1, 0, 2).copy()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, state, error) of each usable row, and the final codebooks.

    Takes vec_id long, embedding array of numbers, label int.  ``state`` holds one
    STATE record a part; ``code`` turns it into text.
    """
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    book = _start(rows, parts, entries, scale)
    if book is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("state"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    history, previous = [book], None
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
    for t in range(rounds + 1):
        held = [b.copy() for b in history]
        table, path = stored_at(rows.mapInArrow(lambda batches, held=held, last=t == rounds: _round(batches, held, scale, last), ROWS))
        if previous:
            dropped(vectors.sparkSession, previous)
        rows, previous = table.filter("part IS NULL").select("vec_id", "label", "vector", "state", "error"), path
        if t == rounds:
            return rows.select("vec_id", "label", "state", "error"), book
        changes = table.filter("part IS NOT NULL").groupBy("part", "entry")
        width = book.shape[2]
        for c in changes.agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)]).collect():
            counts[c.part, c.entry] += c.n
            sums[c.part, c.entry] += np.array(c[3:], np.int64)
        used = counts[..., None] > 0
        book = np.where(used, sums // np.maximum(counts, 1)[..., None], book)
        history.append(book)
    raise AssertionError("not reached")


def code(state: Column, parts: int = PARTS) -> Column:
    """Two hexadecimal digits a part, taken from the first byte of its STATE record."""
    size = 2 * np.dtype(STATE).itemsize
    digits = F.lower(F.hex(state))
    return F.concat(*[F.substring(digits, size * k + 1, 2) for k in range(parts)])


def codebook_text(book: np.ndarray) -> str:
    """All entries' integers by part, entry and position."""
    return ",".join(map(str, book.ravel().tolist()))


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each usable row."""
    rows, book = compress(vectors)
    per_label = rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    met = rows.join(checked_broadcast(per_label, 32), F.col("label").eqNullSafe(F.col("__label")))
    digest = hashlib.sha256(codebook_text(book).encode()).hexdigest()
    return met.select("vec_id", code(F.col("state")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = 64 // PARTS) -> str:
    """Plain full searches, one pair of tables a round, for vectors of parts * width components."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""cut AS MATERIALIZED (
  SELECT r, part, list_slice(v, part * {width} + 1, part * {width} + {width}) AS v
  FROM kept, range({parts}) AS p(part))""",
        f"book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM cut WHERE r <= {entries})",
    ]
    distance = "list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for t in range(rounds + 1):
        steps.append(
            f"""near{t} AS MATERIALIZED (
  SELECT r, part, min(struct_pack(d := d, entry := entry)) AS m
  FROM (SELECT c.r, c.part, b.entry, CAST({distance} AS BIGINT) AS d FROM cut c JOIN book{t} b USING (part)) GROUP BY 1, 2)"""
        )
        if t < rounds:
            means = ", ".join(f"CAST(floor_div(sum(c.v[{k + 1}]), count(*)) AS BIGINT)" for k in range(width))
            steps.append(
                f"""book{t + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.v, b.v) AS v
  FROM book{t} b LEFT JOIN (
    SELECT c.part, m.entry, [{means}] AS v FROM near{t} a JOIN cut c USING (r, part) GROUP BY 1, 2) n USING (part, entry))"""
            )
    last = f"near{rounds}"
    steps.append(f"books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})")
    steps.append(f"coded AS (SELECT r, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM {last} GROUP BY r)")
    body = ",\n".join(steps)
    for k in range(width):  # exact floor division of a sum of any sign
        s = f"sum(c.v[{k + 1}])"
        body = body.replace(f"floor_div({s}, count(*))", f"({s} - ((({s} % count(*)) + count(*)) % count(*))) // count(*)")
    return f"""
WITH {body}
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.codebooks_sha256
FROM kept k JOIN coded c USING (r), books b"""


SQL = _sql()
