"""Merging Parquet files by copying their encoded blocks; no page is decoded.

Two ways, chosen per file:

* *fused*: a file whose column chunks carry no dictionary page contributes its
  data pages to one large row group. Pages are self-contained, so a chunk is
  the concatenation of the pages of many files, in the order of the files.
* *carried*: a file with dictionaries keeps its row groups; their bytes are
  copied as they are and every offset in the footer is moved.

The footer of the result is the first file's, with row groups, row counts and
statistics rewritten. Page indexes and bloom filters live outside the copied
ranges, so their pointers are dropped. Bounds of a fused chunk are merged in
the order of the column's logical type (``bounds_order``); where that order is
not known, or a file does not state it, the chunk gets no bounds, so a pushed
filter reads it rather than losing rows.
"""

from __future__ import annotations

import hashlib
import math
import struct as packing
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from runefold.functions import thrift
from runefold.functions.thrift import BINARY, I32, I64, LIST, STRUCT

MAGIC = b"PAR1"
# Field ids of the public Parquet footer definition.
SCHEMA, NUM_ROWS, ROW_GROUPS, COLUMN_ORDERS, ENCRYPTION = 2, 3, 4, 7, 8
SE_TYPE, SE_CONVERTED, SE_LOGICAL = 1, 6, 10
BOOLEAN, INT32, INT64, FLOAT, DOUBLE, BYTES, FIXED = 0, 1, 2, 4, 5, 6, 7
LT_DECIMAL, LT_INTEGER = 5, 10
# Annotations whose values sort as signed numbers, as unsigned numbers, and byte by byte (converted and logical types).
SIGNED_CONVERTED, UNSIGNED_CONVERTED, TEXT_CONVERTED, DECIMAL_CONVERTED = (5, 6, 7, 8, 9, 10, 15, 16, 17, 18), (11, 12, 13, 14), (0, 4, 19, 20), 5
SIGNED_LOGICAL, TEXT_LOGICAL = (5, 6, 7, 8), (1, 4, 12, 13, 14)
DICTIONARY_ENCODINGS = (2, 8)
RG_COLUMNS, RG_BYTES, RG_ROWS, RG_OFFSET, RG_COMPRESSED, RG_ORDINAL = 1, 2, 3, 5, 6, 7
CC_OFFSET, CC_META = 2, 3
CM_TYPE, CM_ENCODINGS, CM_CODEC, CM_VALUES, CM_RAW, CM_SIZE, CM_DATA, CM_INDEX, CM_DICT, CM_STATS = 1, 2, 4, 5, 6, 7, 9, 10, 11, 12
OUTSIDE_CHUNK, OUTSIDE_META = (4, 5, 6, 7), (14, 15)
ST_NULLS, ST_MAX, ST_MIN = 3, 5, 6


class BlockError(ValueError):
    """A file is no Parquet file, or the merged file fails its validation."""


def bounds_order(element: dict) -> Callable | None:
    """Sort key for the encoded bounds of a column, from its schema element; None where bounds can't be merged.

    A logical type counts before the older converted one. Unsigned integers,
    decimals held as bytes and floats (zeros of either sign apart, NaN never a
    bound) have orders of their own; INT96, intervals and types not known here have none.
    """
    kind = element[SE_TYPE][1]
    logical = next(iter(element[SE_LOGICAL][1].items()), None) if SE_LOGICAL in element else None
    converted = element[SE_CONVERTED][1] if SE_CONVERTED in element else None
    name = logical[0] if logical else None
    if name is None:
        plain, decimal = converted is None, converted == DECIMAL_CONVERTED
        signed, unsigned, text = converted in SIGNED_CONVERTED, converted in UNSIGNED_CONVERTED, converted in TEXT_CONVERTED
    else:
        plain, decimal, text = False, name == LT_DECIMAL, name in TEXT_LOGICAL
        is_signed = name == LT_INTEGER and logical[1][1].get(2, (thrift.TRUE,))[0] == thrift.TRUE
        signed, unsigned = name in SIGNED_LOGICAL or is_signed, name == LT_INTEGER and not is_signed
    if kind in (INT32, INT64):
        if not (plain or signed or unsigned):
            return None
        width = 4 if kind == INT32 else 8
        return lambda b: int.from_bytes(b[:width], "little", signed=not unsigned)
    if kind in (FLOAT, DOUBLE) and plain:
        form = "<f" if kind == FLOAT else "<d"
        return lambda b: (v := packing.unpack(form, b)[0], math.copysign(1, v))
    if kind in (BYTES, FIXED):
        if decimal:
            return lambda b: int.from_bytes(b, "big", signed=True)
        return bytes if plain or text else None
    return bytes if kind == BOOLEAN and plain else None


@dataclass
class Footer:
    """Parsed footer of one file."""

    meta: dict

    @property
    def rows(self) -> int:
        return self.meta[NUM_ROWS][1]

    @property
    def groups(self) -> list[dict]:
        return self.meta[ROW_GROUPS][1][1] if ROW_GROUPS in self.meta else []

    @cached_property
    def fingerprint(self) -> str:
        """Of the schema and of the orders in which bounds are stated: what must agree for files to share chunks."""
        schema, orders = self.meta[SCHEMA], self.meta.get(COLUMN_ORDERS)
        if _last_print and _last_print[0] is schema and _last_print[1] == orders:
            return _last_print[2]
        print_ = hashlib.sha256(thrift.dump({SCHEMA: schema} | ({COLUMN_ORDERS: orders} if orders else {}))).hexdigest()[:16]
        _last_print[:] = schema, orders, print_
        return print_

    def orders(self) -> list[Callable | None]:
        """Per leaf column how its bounds sort."""
        leaves = [e for e in self.meta[SCHEMA][1][1] if SE_TYPE in e]
        stated = self.meta[COLUMN_ORDERS][1][1] if COLUMN_ORDERS in self.meta else []
        # 1: the order that the column's type defines. Bounds under another order, or none, can't be read.
        known = [1 in o for o in stated] if len(stated) == len(leaves) else [False] * len(leaves)
        return [bounds_order(e) if k else None for e, k in zip(leaves, known)]

    def fusible(self) -> bool:
        """No chunk has a dictionary: neither an offset of one nor, as older writers left it out, an encoding that needs one."""
        metas = [c[CC_META][1] for g in self.groups for c in g[RG_COLUMNS][1][1]]
        return all(CM_DICT not in m and not any(e in DICTIONARY_ENCODINGS for e in m[CM_ENCODINGS][1][1]) for m in metas)


#: Neighbouring small files mostly have one schema: it is read, and hashed, once.
_schema_read = thrift.Prefix(SCHEMA)
_last_print: list = []


def read_footer(data) -> Footer:
    """Footer from the whole bytes, or the tail, of a file."""
    end = data[-8:] if len(data) >= 12 else b""
    if end[4:] != MAGIC:
        raise BlockError("no Parquet file")
    n = packing.unpack("<I", end[:4])[0]
    if n + 8 > len(data):
        raise BlockError("footer is longer than the bytes given")
    footer = Footer(thrift.load(data[-8 - n : -8], _schema_read))
    if ENCRYPTION in footer.meta:
        raise BlockError("encrypted files can't be merged")
    return footer


def _span(chunk: dict) -> tuple[int, int]:
    m = chunk[CC_META][1]
    start = min(m[f][1] for f in (CM_DATA, CM_DICT, CM_INDEX) if f in m and m[f][1] > 0)
    return start, m[CM_SIZE][1]


def _merged_stats(metas: list[dict], order: Callable | None) -> dict | None:
    """Null count and bounds over several chunks; what can't be told without decoding is left out."""
    nulls, low, high = 0, None, None
    for m in metas:
        s = m[CM_STATS][1] if CM_STATS in m else None
        if s is None or ST_NULLS not in s:
            return None
        nulls += s[ST_NULLS][1]
        if order is None or s[ST_NULLS][1] == m[CM_VALUES][1]:
            continue
        if ST_MIN not in s or ST_MAX not in s:
            order = None
            continue
        ends = s[ST_MIN][1], s[ST_MAX][1]
        if any(isinstance(k := order(b), tuple) and k[0] != k[0] for b in ends):
            order = None  # NaN is no bound
            continue
        low = ends[0] if low is None else min(low, ends[0], key=order)
        high = ends[1] if high is None else max(high, ends[1], key=order)
    out = {ST_NULLS: (I64, nulls)}
    if order is not None and low is not None:
        out |= {ST_MAX: (BINARY, high), ST_MIN: (BINARY, low)}
    return out


class Chunk:
    """One column of the fused row group that is open: the pages so far and what its footer needs."""

    def __init__(self, order: Callable | None):
        self.order, self.pages, self.kind, self.encodings = order, [], {}, set()
        self.values = self.raw = 0
        self.stats: list[dict] = []

    def add(self, meta: dict, pages) -> None:
        self.pages.append(pages)
        self.kind = self.kind or {k: v for k, v in meta.items() if k in (CM_TYPE, 3, CM_CODEC)}
        self.encodings.update(meta[CM_ENCODINGS][1][1])
        self.values += meta[CM_VALUES][1]
        self.raw += meta[CM_RAW][1]
        self.stats.append({k: meta[k] for k in (CM_VALUES, CM_STATS) if k in meta})
        if len(self.stats) >= 64:  # many small chunks: bounds are merged as they come
            self._shrink()

    def _shrink(self) -> dict | None:
        merged = _merged_stats(self.stats, self.order)
        if merged is not None and ST_MIN not in merged and merged[ST_NULLS][1] < sum(m[CM_VALUES][1] for m in self.stats):
            self.order = None
        self.stats = [{CM_VALUES: (I64, self.values)} | ({CM_STATS: (STRUCT, merged)} if merged is not None else {})]
        return merged


class Ranged:
    """Bytes of a large file, read as they are asked for."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> bytes:
        begin, end, _ = at.indices(self.size)
        self.file.seek(begin)
        return self.file.read(max(0, end - begin))


class BlockWriter:
    """Appends files' blocks to one output. ``group_bytes`` bounds a fused row group."""

    def __init__(self, sink, group_bytes: int = 64 << 20):
        self.sink, self.group_bytes = sink, group_bytes
        self.at, self.first, self.orders, self.out = 4, None, [], []
        self.open: list[Chunk] = []
        self.open_codecs: tuple = ()
        self.open_bytes = self.open_rows = self.open_raw = self.rows = self.files = self.blocks_in = 0
        sink.write(MAGIC)

    def add(self, data, footer: Footer | None = None, files: int = 1) -> None:
        """Append a file, given as its bytes or as ``Ranged``; ``files`` is how many it stands for."""
        footer = footer or read_footer(data)
        if self.first is None:
            self.first, self.orders = footer, footer.orders()
        elif footer.fingerprint != self.first.fingerprint:
            raise BlockError("schemas differ")
        self.files += files
        self.rows += footer.rows
        fuse = footer.fusible()
        for g in footer.groups:
            self.blocks_in += 1
            if not g[RG_ROWS][1]:
                continue
            if fuse:
                self._fuse(g, data)
            else:
                self._flush()
                self._carry(g, data)

    def _fuse(self, g: dict, data) -> None:
        codecs = self._codecs(g)
        if codecs != self.open_codecs:
            self._flush()
        if not self.open:
            self.open, self.open_codecs = [Chunk(o) for o in self.orders], codecs
        for chunk, c in zip(self.open, g[RG_COLUMNS][1][1]):
            at, size = _span(c)
            chunk.add(c[CC_META][1], data[at : at + size])
            self.open_bytes += size
        self.open_rows += g[RG_ROWS][1]
        self.open_raw += g[RG_BYTES][1]
        if self.open_bytes >= self.group_bytes:
            self._flush()

    @staticmethod
    def _codecs(g: dict) -> tuple:
        return tuple(c[CC_META][1][CM_CODEC][1] for c in g[RG_COLUMNS][1][1])

    def _put(self, part: bytes) -> None:
        self.sink.write(part)
        self.at += len(part)

    def _seal(self, columns: list[dict], rows: int, raw: int, start: int) -> None:
        self.out.append(
            {
                RG_COLUMNS: (LIST, (STRUCT, columns)),
                RG_BYTES: (I64, raw),
                RG_ROWS: (I64, rows),
                RG_OFFSET: (I64, start),
                RG_COMPRESSED: (I64, self.at - start),
            }
        )

    def _carry(self, g: dict, data) -> None:
        start, columns = self.at, []
        for c in g[RG_COLUMNS][1][1]:
            begin, size = _span(c)
            move = self.at - begin
            meta = {k: v for k, v in c[CC_META][1].items() if k not in OUTSIDE_META}
            for f in (CM_DATA, CM_INDEX, CM_DICT):
                if f in meta and meta[f][1] > 0:
                    meta[f] = (I64, meta[f][1] + move)
            columns.append({k: v for k, v in c.items() if k not in OUTSIDE_CHUNK} | {CC_OFFSET: (I64, self.at), CC_META: (STRUCT, meta)})
            self._put(data[begin : begin + size])
        self._seal(columns, g[RG_ROWS][1], g[RG_BYTES][1], start)

    def _flush(self) -> None:
        if not self.open:
            return
        start, columns = self.at, []
        for chunk in self.open:
            begin = self.at
            for pages in chunk.pages:
                self._put(pages)
            meta = chunk.kind | {
                CM_ENCODINGS: (LIST, (I32, sorted(chunk.encodings))),
                CM_VALUES: (I64, chunk.values),
                CM_RAW: (I64, chunk.raw),
                CM_SIZE: (I64, self.at - begin),
                CM_DATA: (I64, begin),
            }
            if (stats := chunk._shrink()) is not None:
                meta[CM_STATS] = (STRUCT, stats)
            columns.append({CC_OFFSET: (I64, begin), CC_META: (STRUCT, meta)})
        self._seal(columns, self.open_rows, self.open_raw, start)
        self.open, self.open_codecs = [], ()
        self.open_bytes = self.open_rows = self.open_raw = 0

    def close(self) -> int:
        """Write the footer; bytes of the file."""
        self._flush()
        if self.first is None:
            raise BlockError("nothing was added")
        meta = dict(self.first.meta)
        meta[NUM_ROWS] = (I64, self.rows)
        meta[ROW_GROUPS] = (LIST, (STRUCT, self.out))
        body = thrift.dump(meta)
        self._put(body + packing.pack("<I", len(body)) + MAGIC)
        if sum(g[RG_ROWS][1] for g in self.out) != self.rows:
            raise BlockError("row groups do not add up to the rows of the inputs")
        return self.at
