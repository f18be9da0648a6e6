"""Thrift compact protocol, as far as Parquet footers need it.

A struct is an ordered ``dict`` of field id to ``(type, value)``; a list is
``(element type, [values])``. Unknown fields survive a round trip unchanged,
so footers written by newer writers keep everything that is not touched.
"""

from __future__ import annotations

STOP, TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(13)


def _number(data: bytes, at: int) -> tuple[int, int]:
    """(variable-length number at ``at``, place after it)."""
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def _read(data: bytes, at: int, kind: int):
    """(value of a type at ``at``, place after it)."""
    if kind == BINARY:
        n, at = _number(data, at)
        if at + n > len(data):
            raise ValueError("truncated footer")
        return data[at : at + n], at + n
    if I16 <= kind <= I64:
        n, at = _number(data, at)
        return (n >> 1) ^ -(n & 1), at
    if kind == STRUCT:
        return _read_struct(data, at)
    if kind in (LIST, SET):
        head = data[at]
        n, of, at = head >> 4, head & 15, at + 1
        if n == 15:
            n, at = _number(data, at)
        items = []
        for _ in range(n):
            v, at = _read(data, at, of)
            items.append(v)
        return (of, items), at
    if kind in (TRUE, FALSE, BYTE):  # inside lists a bool is one byte
        return data[at], at + 1
    if kind == DOUBLE:
        if at + 8 > len(data):
            raise ValueError("truncated footer")
        return data[at : at + 8], at + 8
    raise ValueError(f"type {kind} does not occur in Parquet footers")


def _read_struct(data: bytes, at: int, out: dict | None = None, field: int = 0, keep: Prefix | None = None) -> tuple[dict, int]:
    out = {} if out is None else out
    while head := data[at]:
        at += 1
        kind = head & 15
        if head >> 4:
            field += head >> 4
        else:
            field, at = _read(data, at, I16)
        if I16 <= kind <= I64:  # most fields, so without a call where one byte holds them
            b = data[at]
            if b < 0x80:
                at += 1
            else:
                b, at = _number(data, at)
            out[field] = (kind, (b >> 1) ^ -(b & 1))
        elif kind <= FALSE:
            out[field] = (kind, None)
        else:
            v, at = _read(data, at, kind)
            out[field] = (kind, v)
        if keep is not None and field == keep.field:
            keep.data, keep.out = data[:at], dict(out)
    return out, at + 1


def _varint(n: int, out: bytearray) -> None:
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _value(kind: int, v, out: bytearray) -> None:
    if kind in (I16, I32, I64):
        _varint(v << 1 if v >= 0 else (-v << 1) - 1, out)
    elif kind == BINARY:
        _varint(len(v), out)
        out += v
    elif kind == STRUCT:
        out += dump(v)
    elif kind in (LIST, SET):
        of, items = v
        if len(items) < 15:
            out.append(len(items) << 4 | of)
        else:
            out.append(0xF0 | of)
            _varint(len(items), out)
        for x in items:
            _value(of, x, out)
    elif kind in (TRUE, FALSE, BYTE):
        out.append(v)
    else:
        out += v


def dump(struct: dict) -> bytes:
    out, last = bytearray(), 0
    for field, (kind, v) in sorted(struct.items()):
        if 0 < field - last < 16:
            out.append(field - last << 4 | kind)
        else:
            out.append(kind)
            _value(I16, field, out)
        last = field
        if kind not in (TRUE, FALSE):
            _value(kind, v, out)
    out.append(STOP)
    return bytes(out)


class Prefix:
    """The leading fields, up to ``field``, of the struct read last: where the next one begins with the same bytes they are not read again."""

    def __init__(self, field: int):
        self.field, self.data, self.out = field, None, {}


def load(data: bytes, prefix: Prefix | None = None) -> dict:
    try:
        if prefix is not None and prefix.data is not None and data.startswith(prefix.data):
            return _read_struct(data, len(prefix.data), dict(prefix.out), prefix.field)[0]
        return _read_struct(data, 0, keep=prefix)[0]
    except IndexError:
        raise ValueError("truncated footer") from None
