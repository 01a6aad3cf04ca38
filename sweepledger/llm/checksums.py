"""CRC-32C of many records at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
BLOCK = 64


@lru_cache(maxsize=1)
def _step() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


@lru_cache(maxsize=64)
def _advance_tables(power: int) -> np.ndarray:
    """Four tables that carry a checksum over ``2 ** power`` zero bytes."""
    if power == 0:
        one = np.uint32(1) << np.arange(32, dtype=np.uint32)
        columns = _step()[one & 255] ^ (one >> 8)
    else:
        half = _advance_tables(power - 1)
        one = np.uint32(1) << np.arange(32, dtype=np.uint32)
        columns = _apply(half, _apply(half, one))
    byte = np.arange(256)
    return np.stack(
        [np.bitwise_xor.reduce(np.where((byte[:, None] >> np.arange(8)) & 1, columns[8 * k : 8 * k + 8], 0), axis=1) for k in range(4)]
    ).astype(np.uint32)


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _advance(crc: np.ndarray, lengths: np.ndarray, unit: int = 0) -> np.ndarray:
    """Each checksum carried over its own number of zero bytes, in units of ``2 ** unit``."""
    crc = crc.copy()
    for bit in range(int(lengths.max(initial=0)).bit_length()):
        chosen = (lengths >> bit) & 1 == 1
        crc[chosen] = _apply(_advance_tables(bit + unit), crc[chosen])
    return crc


def crc32c_many(records: list[bytes]) -> np.ndarray:
    """The CRC-32C of each record.

    Records are laid out in blocks of 64 bytes, zeros in front (which change nothing while the
    checksum is zero); all blocks go through one table step at a time, are carried to the end of
    their record and combined.
    """
    if not records:
        return np.zeros(0, np.uint32)
    lengths = np.array([len(r) for r in records], np.int64)
    blocks = np.maximum(1, -(-lengths // BLOCK))
    ends = np.cumsum(blocks)
    laid = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    for record, end in zip(records, (ends * BLOCK).tolist()):
        laid[end - len(record) : end] = np.frombuffer(record, np.uint8)
    columns = np.ascontiguousarray(laid.reshape(-1, BLOCK).T)
    step, crc = _step(), np.zeros(len(laid) // BLOCK, np.uint32)
    for column in columns:
        crc = step[(crc ^ column) & 255] ^ (crc >> 8)
    after = np.repeat(ends, blocks) - 1 - np.arange(len(crc))
    crc = np.bitwise_xor.reduceat(_advance(crc, after, BLOCK.bit_length() - 1), ends - blocks)
    return crc ^ _advance(np.full(len(records), 0xFFFFFFFF, np.uint32), lengths) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated by 15 bits plus a constant, so that a checksum of data holding checksums stays sound."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
