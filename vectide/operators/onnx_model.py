"""A linear layer as an ONNX model, written without any ONNX package: the format is protocol buffers."""

from __future__ import annotations

import struct


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, x: bytes | str) -> bytes:
    x = x.encode() if isinstance(x, str) else x
    return _varint(field << 3 | 2) + _varint(len(x)) + x


def _tensor(name: str, shape: list[int], values: list[float]) -> bytes:
    return b"".join(_int(1, n) for n in shape) + _int(2, 1) + _bytes(8, name) + _bytes(9, struct.pack(f"<{len(values)}f", *values))


def _value(name: str, columns: int) -> bytes:
    shape = _bytes(1, _bytes(2, "n")) + _bytes(1, _int(1, columns))
    return _bytes(1, name) + _bytes(2, _bytes(1, _int(1, 1) + _bytes(2, shape)))


def linear(weight: list[list[float]], bias: list[float]) -> bytes:
    """``y = x weight + bias`` over float rows named ``x``."""
    rows, columns = len(weight), len(bias)
    product = _bytes(1, "x") + _bytes(1, "w") + _bytes(2, "p") + _bytes(4, "MatMul")
    total = _bytes(1, "p") + _bytes(1, "b") + _bytes(2, "y") + _bytes(4, "Add")
    graph = _bytes(1, product) + _bytes(1, total) + _bytes(2, "linear")
    graph += _bytes(5, _tensor("w", [rows, columns], [v for r in weight for v in r])) + _bytes(5, _tensor("b", [columns], bias))
    graph += _bytes(11, _value("x", rows)) + _bytes(12, _value("y", columns))
    return _int(1, 8) + _bytes(7, graph) + _bytes(8, _bytes(1, "") + _int(2, 13))
