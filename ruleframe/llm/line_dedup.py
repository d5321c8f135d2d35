"""Line dedup with two Bloom filters and an exact check of suspected repeats.

Plan
----
1. Every task splits its texts into lines, normalises them to keys and notes
   each key of a row once.  It marks the key's hash positions in two bit
   arrays: *once* (seen) and *twice* (seen again).  The arrays have a fixed
   number of bits and leave the task as compressed blocks.
2. Blocks of different tasks are merged in order: a bit goes to *twice* if it
   is set in what came before and in the new block.  With AND over all
   positions of a key there are no false negatives, so a key that is in two
   rows always passes the twice-filter.
3. Only keys that pass the twice-filter are shuffled (hot keys are counted in
   the map tasks first).  Exact counts decide which keys repeat, and the least
   row id has the first occurrence, which can be kept (``keep_first``).
4. The repeated keys go back to the texts: as a broadcast set while their
   measured size is under ``broadcast_bytes``, by joins on the key and then on
   the row id beyond it.  Both ways return the same rows.

The filters get about ``BITS_PER_LINE`` bits a line, up to ``2 ** filter_bits``
bits, so what is broadcast has a proven bound (128 MB at the default).  Beyond
some 10 ** 9 lines the filter fills up; it then lets more lines through to the
exact stage, and results never change.

Defined results: a null text counts as empty, and an empty text is one empty
line.  Empty keys are never repeats.  A row given twice counts as two
documents.  The order of equal lines within a text is kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ruleframe.llm.common import ASCII_SPACE, mapped, stored

BLOCK_BITS = 20
FILTER_BITS = 30
BITS_PER_LINE = 12
HASHES = 2
BROADCAST_BYTES = 8 << 20


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(ASCII_SPACE).lower()


def positions(keys: list[bytes], bits: int) -> np.ndarray:
    """One row of ``HASHES`` bit positions per key."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
    mask = np.uint64((1 << bits) - 1)
    return np.stack([(h >> np.uint64(0)) & mask, (h >> np.uint64(64 - bits)) & mask], axis=1)


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(bits.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.uint8)


def _local_filters(column: str, bits: int):
    """Per task: the blocks of its own once- and twice-filter."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(1 << (bits - 3), dtype=np.uint8)
        twice = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for batch in source:
            for text in batch.column(batch.schema.get_field_index(column)):
                keys = list({k for k in map(line_key, lines_of(text.as_py())) if k})
                if not keys:
                    continue
                at = positions(keys, bits)
                byte, bit = at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
                seen = ((once[byte] & bit) != 0).all(axis=1)
                if seen.any():
                    np.bitwise_or.at(twice, byte[seen].ravel(), bit[seen].ravel())
                np.bitwise_or.at(once, byte.ravel(), bit.ravel())
        size = 1 << (min(BLOCK_BITS, bits) - 3)
        for block in range(len(once) // size):
            part = once[block * size : (block + 1) * size]
            if part.any():
                yield pa.RecordBatch.from_pydict(
                    {"block": [block], "once": [_pack(part)], "twice": [_pack(twice[block * size : (block + 1) * size])]},
                    schema=pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]),
                )

    return run


def _merge_filters(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold sorted blocks; two bit arrays of one block are held at a time."""
    schema = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    block = once = twice = None
    for batch in source:
        for b, o, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            o, t = _unpack(o), _unpack(t)
            if b != block:
                if block is not None:
                    yield pa.RecordBatch.from_pydict({"block": [block], "once": [_pack(once)], "twice": [_pack(twice)]}, schema=schema)
                block, once, twice = b, o.copy(), t.copy()
            else:
                twice |= t | (once & o)
                once |= o
    if block is not None:
        yield pa.RecordBatch.from_pydict({"block": [block], "once": [_pack(once)], "twice": [_pack(twice)]}, schema=schema)


def bits_for(docs: DataFrame, text: str, most: int) -> int:
    """Filter size for the exact number of lines, as a power of two."""
    n = docs.agg(F.sum(F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).alias("n")).first().n or 0
    return max(10, min(most, int(n * BITS_PER_LINE).bit_length()))


def repeat_filter(docs: DataFrame, text: str = "text", bits: int = FILTER_BITS) -> dict[int, bytes]:
    """Compressed blocks of the twice-filter: at most ``2 ** bits`` bits."""
    schema = "block int, once binary, twice binary"
    local = docs.select(text).transform(mapped, _local_filters(text, bits), schema)
    blocks = max(1, 1 << max(0, bits - BLOCK_BITS))
    merged = local.repartition(blocks, "block").sortWithinPartitions("block").transform(mapped, _merge_filters, schema)
    return {r.block: bytes(r.twice) for r in merged.select("block", "twice").collect()}


def filter_array(blocks: dict[int, bytes], bits: int) -> np.ndarray:
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    size = 1 << (min(BLOCK_BITS, bits) - 3)
    for b, data in blocks.items():
        out[b * size : (b + 1) * size] = _unpack(data)
    return out


def suspects(docs: DataFrame, text: str, row_id: str | None, shared, bits: int) -> DataFrame:
    """Keys of each row that pass the twice-filter, once per row."""
    kind = docs.schema[row_id].dataType.simpleString() if row_id else None
    fields = [("key", pa.binary())]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in source:
            ids = batch.column(1) if row_id else None
            keys_out: list[bytes] = []
            at_out: list[int] = []
            for i, value in enumerate(batch.column(0).to_pylist()):
                keys = list({k for k in map(line_key, lines_of(value)) if k})
                if not keys:
                    continue
                at = positions(keys, bits)
                hit = ((twice[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
                found = [k for k, ok in zip(keys, hit, strict=True) if ok]
                keys_out += found
                at_out += [i] * len(found)
            if keys_out:
                columns = {"key": pa.array(keys_out, pa.binary())}
                if row_id:
                    columns["row"] = ids.take(pa.array(at_out, pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(text, *([row_id] if row_id else [])).transform(mapped, run, "key binary" + (f", row {kind}" if row_id else ""))


def repeated_lines(docs: DataFrame, text: str = "text", row_id: str = "doc_id", min_documents: int = 10, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Exact table ``key, n_documents, first_row`` of lines in at least
    ``min_documents`` rows; ``first_row`` is the least id that has the line."""
    if min_documents < 2:
        raise ValueError("min_documents must be at least 2")
    spark = docs.sparkSession
    bits = bits_for(docs, text, filter_bits)
    shared = spark.sparkContext.broadcast(filter_array(repeat_filter(docs, text, bits), bits))
    found = suspects(docs, text, row_id, shared, bits)
    counted = found.groupBy("key").agg(F.count(F.lit(1)).alias("n_documents"), F.min("row").alias("first_row"))
    return counted.where(F.col("n_documents") >= min_documents)


def _strip(values: list[str | None], drops: list[Container[bytes]], firsts: list[set[bytes]]) -> dict[str, list]:
    """Texts without the lines whose keys are in ``drops``, but for the first of each in ``firsts``."""
    out: dict[str, list] = {"n_lines": [], "n_dropped": [], "kept": []}
    for value, drop, first in zip(values, drops, firsts, strict=True):
        lines, kept, left = lines_of(value), [], set(first)
        for line in lines:
            key = line_key(line)
            if key not in drop or key in left:
                kept.append(line)
                left.discard(key)
        out["n_lines"].append(len(lines))
        out["n_dropped"].append(len(lines) - len(kept))
        out["kept"].append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
    return out


def drop_repeated_lines(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    min_documents: int = 10,
    filter_bits: int = FILTER_BITS,
    broadcast_bytes: int = BROADCAST_BYTES,
    keep_first: bool = False,
) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus ``n_lines`` and ``n_dropped``.

    A repeated line goes from every row, or with ``keep_first`` from all but its
    first occurrence (in rows of the least id that has it; rows without an id
    are never first).  All columns of ``docs`` stay as they are but for
    ``text``; input columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    repeated = stored(repeated_lines(docs, text, row_id, min_documents, filter_bits), "repeated-lines")
    id_bytes = F.octet_length(F.col("first_row").cast("string").cast("binary")) if keep_first else F.lit(0)
    size = repeated.agg(F.sum(F.octet_length("key") + F.coalesce(id_bytes, F.lit(0)) + F.lit(64)).alias("n")).first().n or 0
    names = docs.columns
    if size > broadcast_bytes:
        return _drop_by_join(docs, repeated, text, row_id, keep_first)
    first = {bytes(r.key): r.first_row if keep_first else None for r in repeated.select("key", "first_row").toLocalIterator()}
    shared = spark.sparkContext.broadcast(first)
    at, id_at = names.index(text), names.index(row_id)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines bigint, n_dropped bigint"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared.value
        for batch in source:
            texts, own = batch.column(at).to_pylist(), [set()] * batch.num_rows
            if keep_first:
                ids = batch.column(id_at).to_pylist()
                own = [{k for k in map(line_key, lines_of(t)) if k in first and i is not None and first[k] == i} for t, i in zip(texts, ids, strict=True)]
            done = _strip(texts, [first] * len(texts), own)
            columns = list(batch.columns)
            columns[at] = pa.array(done["kept"], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(done["n_lines"], pa.int64()), pa.array(done["n_dropped"], pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return docs.transform(mapped, run, schema)


def _drop_by_join(docs: DataFrame, repeated: DataFrame, text: str, row_id: str, keep_first: bool) -> DataFrame:
    """The way beyond the broadcast bound.

    Rows get a salted surrogate so that equal ids stay apart; a hot line is
    split by the adaptive skew join, and the marks of one row are as many as
    its own lines.
    """
    tagged = stored(docs.withColumn("__row", F.expr("uuid()")), "tagged-docs")

    def explode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = list({k for k in map(line_key, lines_of(value)) if k})
                if keys:
                    yield pa.RecordBatch.from_pydict({"__row": pa.array([row] * len(keys), pa.string()), "key": pa.array(keys, pa.binary())})

    marks = tagged.select("__row", text).transform(mapped, explode, "__row string, key binary").join(repeated.select("key", "first_row"), "key")
    per_row = marks.groupBy("__row").agg(F.collect_list(F.struct("key", "first_row")).alias("__drop"))
    stays = (lambda d: F.coalesce(d["first_row"] == F.col(row_id), F.lit(False))) if keep_first else (lambda d: F.lit(False))
    joined = tagged.join(per_row, "__row", "left").drop("__row").withColumn("__drop", F.transform("__drop", lambda d: F.struct(d["key"].alias("key"), stays(d).alias("first"))))
    names = joined.columns
    at = names.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines bigint, n_dropped bigint"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            marks = [row or () for row in batch.column(len(names) - 1).to_pylist()]
            drops, own = ([{bytes(d["key"]) for d in row if d["first"] or every} for row in marks] for every in (True, False))
            done = _strip(batch.column(at).to_pylist(), drops, own)
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(done["kept"], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(done[k], pa.int64()) for k in ("n_lines", "n_dropped"))], names=[*names[:-1], "n_lines", "n_dropped"])

    return joined.transform(mapped, run, schema)


def digest(cleaned: DataFrame, text: str = "text") -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col(text).cast("binary"), 256).alias("kept_sha256"))


def sha256_of(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
