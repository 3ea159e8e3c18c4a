"""Gzip bodies inside Arrow batches; Spark has no built-in for it."""

from __future__ import annotations

import sys
import zlib

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"\x1f\x8b"
#: body: all text before the bad spot; reason and byte of the spot, null where there is none.
UNPACKED = "struct<body string, reason string, place bigint>"
_ARROW = pa.struct([("body", pa.string()), ("reason", pa.string()), ("place", pa.int64())])
STEPS = (1 << 16, 1 << 10, 32, 1)


def unpack(packed: bytes) -> tuple[str, str | None, int | None]:
    """Text of a gzip body of one or more members; of a broken one, what comes before the first byte that does not fit."""
    out, at, reason = [], 0, None
    while at < len(packed) and reason is None:
        member, steps = zlib.decompressobj(31), list(STEPS)
        while at < len(packed) and not member.eof:
            before = member.copy() if at or out else zlib.decompressobj(31)
            piece = packed[at : at + steps[0]]
            try:
                out.append(member.decompress(piece))
                at += len(piece) - len(member.unused_data)
            except zlib.error as error:
                if len(steps) == 1:
                    reason = str(error).partition(": ")[2]
                    break
                # the same bytes again in smaller pieces, up to the one that does not fit
                member = before
                steps.pop(0)
        if reason is None and not member.eof:
            reason = "truncated"
        elif reason is None and at < len(packed) and packed[at : at + 2] != MAGIC:
            reason = "bytes after the end"
    if not packed:
        reason = "truncated"
    return b"".join(out).decode("utf-8", "replace"), reason, at if reason else None


def unpack_array(packed: pa.Array) -> pa.Array:
    """Nulls stay null."""
    return pa.array([None if b is None else dict(zip(_ARROW.names, unpack(b))) for b in packed.to_pylist()], _ARROW)
