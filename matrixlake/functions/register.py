"""Names for SQL: the matrix decoder, and the frame scanner as table function."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..operators import codec, vision
from . import tables

KIND = pa.struct([("text", pa.string()), ("bytes", pa.binary()), ("version", pa.int32()), ("ec_level", pa.string()), ("mask", pa.int32()), ("error_code", pa.string())])
DECODED = "struct<text:string,bytes:binary,version:int,ec_level:string,mask:int,error_code:string>"


def decode_matrix(matrix: pa.Array) -> pa.Array:
    """The payload of square matrices, row by row; the size follows from the length."""
    rows = []
    for raw in matrix.to_pylist():
        try:
            n = 0 if raw is None else round(len(raw) ** 0.5)
            if raw is None or n * n != len(raw):
                raise codec.DecodeError("invalid-dimension")
            got = codec.decode(np.frombuffer(raw, np.uint8).reshape(n, n) != 0)
            rows.append({k: got[k] for k in ("text", "bytes", "version", "ec_level", "mask")} | {"error_code": None})
        except codec.DecodeError as e:
            rows.append({"error_code": e.code})
    return pa.array(rows, KIND)


@F.udtf(returnType="text: string, version: int, ec_level: string, module_size: double")
class ScanFrame:
    """Rows of one frame's symbols: SELECT t.* FROM frames, LATERAL qr_scan(data, width, height) t."""

    def eval(self, data: bytes, width: int, height: int):
        try:
            found, _ = vision.scan(vision.gray_of(data, width, height), multiple=True)
        except (codec.DecodeError, TypeError):
            return
        for r in found:
            yield r["text"], r["version"], r["ec_level"], float(r["module_size"])


def qr_decode_matrix(matrix: Column) -> Column:
    """decode_matrix as a column function; evaluated once for each row, whatever is selected of it."""
    return F.arrow_udf(decode_matrix, _parse_datatype_string(DECODED)).asNondeterministic()(matrix)


def register(spark: SparkSession) -> None:
    """qr_decode_matrix(matrix), qr_scan(data, width, height), and the dimension tables as temporary views."""
    spark.udf.register("qr_decode_matrix", F.arrow_udf(decode_matrix, _parse_datatype_string(DECODED)).asNondeterministic())
    spark.udtf.register("qr_scan", ScanFrame)
    for name, df in tables.dimensions(spark).items():
        df.createOrReplaceTempView(name)
