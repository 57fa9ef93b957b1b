"""Names, paths, identifiers and checksums."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Case folds of Unicode 16 and 17 that older tables lack (fixed values): single letters, then two alphabets by offset.
NEWER_FOLDS = {"\ua7cb": "\u0264", "\ua7cc": "\ua7cd", "\ua7ce": "\ua7cf", "\ua7d2": "\ua7d3", "\ua7d4": "\ua7d5", "\ua7da": "\ua7db", "\ua7dc": "\u019b"}
NEWER_FOLDS |= {chr(c): chr(c + 0x20) for c in range(0x10D50, 0x10D66)} | {chr(c): chr(c + 0x1B) for c in range(0x16EA0, 0x16EB9)}
#: Device names that no display name may be, whatever its extension (fixed values).
DEVICES = "con|prn|aux|nul|com[1-9]|lpt[1-9]"
#: Limits of names and paths (fixed values).
MAX_NAME_BYTES, MAX_PATH_BYTES, MAX_COMPONENTS = 255, 4_096, 128
CROCKFORD = "0123456789abcdefghjkmnpqrstvwxyz"
INODE_PREFIX, BODY = "ino_", 26


def fold_name(name: str) -> str:
    """NFC, full case folding, NFC: names that differ in case or composition only share a key."""
    folded = "".join(NEWER_FOLDS.get(c, c) for c in unicodedata.normalize("NFC", name)).casefold()
    return unicodedata.normalize("NFC", folded)


@F.pandas_udf(StringType())
def name_key(names: pd.Series) -> pd.Series:
    return names.map(fold_name, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def path_keys(paths: pd.Series) -> pd.Series:
    """The name keys of a path's components."""
    return paths.map(lambda p: [fold_name(x) for x in p.split("/") if x], na_action="ignore")


def valid_name(name: Column) -> Column:
    """1 to 255 bytes; no slash, control character or any of ``: ? * | " < > \\``; not ``.``, ``..``, blank, a device name, and
    not ending in a space or dot."""
    size = F.octet_length(name)
    bad = name.rlike(r'[/\x00-\x1F\x7F-\x9F:?*|"<>\\]') | name.rlike(r"[ .]$") | name.rlike(r"^\p{IsWhite_Space}*$") | name.rlike(rf"(?i)^(?:{DEVICES})(?:\.|$)")
    return (size >= 1) & (size <= MAX_NAME_BYTES) & ~bad


def components(path: Column) -> Column:
    """Components of an absolute path; none for the root."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def valid_path(path: Column) -> Column:
    """Absolute and canonical, within the limits, each component a valid name."""
    parts = F.split(F.substring(path, 2, MAX_PATH_BYTES), "/")
    named = F.forall(parts, lambda x: valid_name(x)) & (F.size(parts) <= MAX_COMPONENTS)
    return path.startswith("/") & (F.octet_length(path) <= MAX_PATH_BYTES) & ((path == "/") | named)


def parent_path(path: Column) -> Column:
    up = F.array_join(F.slice(components(path), F.lit(1), F.greatest(F.size(components(path)) - 1, F.lit(0))), "/")
    return F.when(path != "/", F.concat(F.lit("/"), up))


def encode_inode(number: int) -> str:
    out = ""
    for _ in range(BODY):
        out, number = CROCKFORD[number & 31] + out, number >> 5
    return INODE_PREFIX + out


def decode_inode(text: str) -> int:
    """The number of an identifier; ValueError unless it is canonical."""
    if not text.startswith(INODE_PREFIX) or len(text) != len(INODE_PREFIX) + BODY:
        raise ValueError(f"not an inode identifier: {text!r}")
    number = 0
    for c in text[len(INODE_PREFIX) :]:
        number = number << 5 | CROCKFORD.index(c)
    if number >> 128:
        raise ValueError(f"out of range: {text!r}")
    return number


@F.pandas_udf(StringType())
def inode_text(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda n: encode_inode(int(n)), na_action="ignore")


def binding_version(namespace: Column, seq: Column, delta_index: Column) -> Column:
    """Opaque token of a bind's position, from which the position can be read again: base 64 of the parts."""
    return F.base64(F.concat_ws(":", seq.cast("string"), delta_index.cast("string"), namespace).cast("binary"))


def binding_position(token: Column) -> Column:
    """namespace, seq and delta_index of a token; null fields where it is none."""
    parts = F.split(F.try_to_binary(token, F.lit("base64")).cast("string"), ":", 3)
    return F.struct(F.get(parts, 2).alias("namespace"), F.get(parts, 0).try_cast("bigint").alias("seq"), F.get(parts, 1).try_cast("bigint").alias("delta_index"))


def fingerprint(*parts: Column) -> Column:
    """Digest of a request's parts, the same for equal requests: names in order, maps by key, nulls told."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false", "sortKeys": "true"}), 256)


#: The largest sequence, revision or other number (fixed value).
MAX_ORDINAL = (1 << 53) - 1


def next_ordinal(number: Column) -> Column:
    """The number after, which may not pass MAX_ORDINAL."""
    return F.when(number < MAX_ORDINAL, number + 1).otherwise(F.raise_error(F.lit("ordinal out of range")).cast("bigint"))


def row_key(kind: str, entity: Column, number: Column) -> Column:
    """Text key of an entity's row, that sorts by entity and then newest first."""
    down = F.lit((1 << 63) - 1) - number
    return F.concat_ws("-", F.lit(kind), F.lpad(entity.cast("string"), 20, "0"), F.lpad(down.cast("string"), 20, "0"))


def _crc64_table() -> np.ndarray:
    n = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        n = np.where(n & np.uint64(1), n >> np.uint64(1) ^ np.uint64(0x9A6C9329AC4BC9B5), n >> np.uint64(1))
    return n


_CRC64 = _crc64_table()


#: Polynomials, reflected (fixed values).
CRC32, CRC64 = 0xEDB88320, 0x9A6C9329AC4BC9B5
_LANES = 1 << 12


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return out


def crc_joined(first: int, second: int, n: int, polynomial: int = CRC64, bits: int = 64) -> int:
    """Checksum of two strings in a row from that of each and the bytes of the second: passing a zero bit is a linear map of the
    state, taken to the power of 8 n by squaring."""
    step = [polynomial, *(1 << i for i in range(bits - 1))]
    power = 8 * n
    while power:
        if power & 1:
            first = _times(step, first)
        step, power = [_times(step, x) for x in step], power >> 1
    return first ^ second


def crc64nvme(data: bytes) -> int:
    """The text's lanes go byte by byte through the table together; then their checksums are joined."""
    table = _CRC64
    n, every = len(data) // _LANES, np.uint64(0xFFFFFFFFFFFFFFFF)
    out = 0
    if n:
        lanes = np.frombuffer(data, np.uint8, n * _LANES).reshape(_LANES, n)
        crc = np.full(_LANES, every)
        for k in range(n):
            crc = table[(crc.astype(np.uint8) ^ lanes[:, k])] ^ (crc >> np.uint64(8))
        for c in (crc ^ every).tolist():
            out = crc_joined(out, c, n)
    rest = 0xFFFFFFFFFFFFFFFF
    for b in data[n * _LANES :]:
        rest = int(table[(rest ^ b) & 255]) ^ rest >> 8
    return crc_joined(out, rest ^ 0xFFFFFFFFFFFFFFFF, len(data) - n * _LANES)


@F.pandas_udf(StringType())
def crc64(values: pd.Series) -> pd.Series:
    return values.map(lambda v: f"{crc64nvme(bytes(v)):016x}", na_action="ignore")


def updated_attributes(before: Column, to_set: Column, to_remove: Column) -> Column:
    """Map with some keys set and others removed."""
    kept = F.map_filter(before, lambda k, _: ~F.array_contains(to_remove, k) & ~F.map_contains_key(to_set, k))
    return F.map_concat(kept, to_set)
