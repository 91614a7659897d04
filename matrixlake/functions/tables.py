"""Fixed values of the symbol standard, and dimension tables built from them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

LEVELS = ("L", "M", "Q", "H")
#: A level's two bits in the format information.
LEVEL_BITS = {"L": 1, "M": 0, "Q": 3, "H": 2}
FORMAT_GENERATOR, FORMAT_MASK, VERSION_GENERATOR, FIELD = 0x537, 0x5412, 0x1F25, 0x11D
ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"
#: Check codewords of a block, by level, versions 1 to 40.
CHECKS = {
    "L": [7, 10, 15, 20, 26, 18, 20, 24, 30, 18, 20, 24, 26, 30, 22, 24, 28, 30, 28, 28, 28, 28, 30, 30, 26, 28, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30],
    "M": [10, 16, 26, 18, 24, 16, 18, 22, 22, 26, 30, 22, 22, 24, 24, 28, 28, 26, 26, 26, 26, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28, 28],
    "Q": [13, 22, 18, 26, 18, 24, 18, 22, 20, 24, 28, 26, 24, 20, 30, 24, 28, 28, 26, 30, 28, 30, 30, 30, 30, 28, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30],
    "H": [17, 28, 22, 16, 22, 28, 26, 26, 24, 28, 24, 28, 22, 24, 24, 30, 28, 28, 26, 28, 30, 24, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30, 30],
}
#: Blocks of a symbol, by level, versions 1 to 40.
BLOCKS = {
    "L": [1, 1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 4, 4, 4, 6, 6, 6, 6, 7, 8, 8, 9, 9, 10, 12, 12, 12, 13, 14, 15, 16, 17, 18, 19, 19, 20, 21, 22, 24, 25],
    "M": [1, 1, 1, 2, 2, 4, 4, 4, 5, 5, 5, 8, 9, 9, 10, 10, 11, 13, 14, 16, 17, 17, 18, 20, 21, 23, 25, 26, 28, 29, 31, 33, 35, 37, 38, 40, 43, 45, 47, 49],
    "Q": [1, 1, 2, 2, 4, 4, 6, 6, 8, 8, 8, 10, 12, 16, 12, 17, 16, 18, 21, 20, 23, 23, 25, 27, 29, 34, 34, 35, 38, 40, 43, 45, 48, 51, 53, 56, 59, 62, 65, 68],
    "H": [1, 1, 2, 4, 4, 4, 5, 6, 8, 8, 11, 11, 16, 16, 18, 16, 19, 21, 25, 25, 25, 34, 30, 32, 35, 37, 40, 42, 45, 48, 51, 54, 57, 60, 63, 66, 70, 74, 77, 81],
}
#: Character sets by extended channel assignment, as Python codecs. Assignments 4 to 18 are two above the
#: parts of ISO 8859 but for 14; Latin-1, Latin-5, Thai and ASCII are read as the supersets that browsers read for them.
#: Other assignments leave the choice to the bytes.
CHARSETS = {1: "cp1252", 3: "cp1252", **{n: f"iso8859_{n - 2}" for n in (4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 17, 18)}, 11: "cp1254", 13: "cp874", 20: "cp932", 21: "cp1250", 22: "cp1251", 23: "cp1252", 24: "cp1256", 25: "utf_16_be", 26: "utf_8", 27: "cp1252", 28: "big5hkscs", 29: "gb18030", 30: "cp949", 170: "cp1252"}
#: Those of them whose characters may take several bytes.
WIDE_CHARSETS = {"cp932", "big5hkscs", "gb18030", "cp949", "utf_16_be", "utf_8"}


def size_of(version: int) -> int:
    return 4 * version + 17


@cache
def alignment(version: int) -> tuple[int, ...]:
    """Centres of alignment patterns along a side: from 6, then evenly spaced back from the far end."""
    if version == 1:
        return ()
    n = version // 7 + 2
    step = 26 if version == 32 else (version * 4 + n * 2 + 1) // (n * 2 - 2) * 2
    return (6, *sorted(size_of(version) - 7 - i * step for i in range(n - 1)))


def data_modules(version: int) -> int:
    """Modules that carry codewords, in closed form."""
    n = (16 * version + 128) * version + 64
    if version > 1:
        k = version // 7 + 2
        n -= (25 * k - 10) * k - 55
    return n - 36 * (version > 6)


@cache
def blocks(version: int, level: str) -> tuple[int, tuple[int, ...]]:
    """(check codewords of each block, data codewords of each block in order)."""
    checks, n = CHECKS[level][version - 1], BLOCKS[level][version - 1]
    data = data_modules(version) // 8 - checks * n
    return checks, tuple(data // n + (i >= n - data % n) for i in range(n))


def remainder(value: int, generator: int) -> int:
    """value times x^degree modulo the generator, over bits."""
    degree = generator.bit_length() - 1
    value <<= degree
    while value.bit_length() > degree:
        value ^= generator << (value.bit_length() - degree - 1)
    return value


FORMATS = [(d << 10 | remainder(d, FORMAT_GENERATOR)) ^ FORMAT_MASK for d in range(32)]
VERSIONS = {v: v << 12 | remainder(v, VERSION_GENERATOR) for v in range(7, 41)}


def dimensions(spark: SparkSession) -> dict[str, DataFrame]:
    """qr_version, qr_ec_block, qr_format and qr_alignment."""
    groups = []
    for v in range(1, 41):
        for level in LEVELS:
            checks, data = blocks(v, level)
            groups += [(v, level, checks, data.count(d), d) for d in sorted(set(data))]
    return {
        "qr_version": spark.createDataFrame([(v, size_of(v), data_modules(v), VERSIONS.get(v)) for v in range(1, 41)], "version int, size int, data_modules int, codeword int"),
        "qr_ec_block": spark.createDataFrame(groups, "version int, ec_level string, ec_codewords int, blocks int, data_codewords int"),
        "qr_format": spark.createDataFrame([(d, c, d & 7, next(k for k, b in LEVEL_BITS.items() if b == d >> 3)) for d, c in enumerate(FORMATS)], "data int, codeword int, mask int, ec_level string"),
        "qr_alignment": spark.createDataFrame([(v, c) for v in range(1, 41) for c in alignment(v)], "version int, centre int"),
    }
