"""Live-scan semantics: throttle, reassembly of split payloads, rolling de-duplication. Batch forms and streaming state.

Times are event times in milliseconds. Within a key, rows are taken by time and then by `order`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

TTL_MS, WINDOW_MS, PARTS = 30_000, 1500, 16
#: Windows in a span of time by which a key is cut.
SPAN = 16


def _order(ts: str, order: list[str]) -> list[Column]:
    return [F.col(ts), *[F.col(c) for c in order]]


def deduplicate(df: DataFrame, keys: list[str], ts: str = "ts", window_ms: int = WINDOW_MS, order: list[str] = ()) -> DataFrame:
    """df with `emit`: never seen, or not sighted for window_ms. Every sighting counts, emitted or not.

    A key is cut into spans of time that are no shorter than the window, so that a frequent one lies in many tasks; the
    last sighting of a span goes ahead of the next one's, which is all that the next one needs to know.
    """
    if window_ms <= 0:
        return df.withColumn("emit", F.lit(True))
    rows = df.withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp"))).withColumn("_span", F.floor(F.col("_ms") / (SPAN * window_ms)))
    last = rows.filter("_ms is not null").groupBy(*keys, "_span").agg(F.max("_ms").alias("_ms")).withColumn("_span", F.col("_span") + 1)
    both = rows.withColumn("_own", F.lit(True)).unionByName(last.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    gap = F.col("_ms") - F.lag("_ms").over(Window.partitionBy(*keys, "_span").orderBy("_ms", *_order(ts, list(order))))
    return both.withColumn("emit", F.coalesce(gap >= window_ms, F.lit(True))).filter("_own").select(*df.columns, "emit")


def throttle(df: DataFrame, keys: list[str], per_second: float, ts: str = "ts", order: list[str] = ()) -> DataFrame:
    """The rows that a scanner takes: at least 1000 / per_second ms after the last one taken. One pass over sorted rows."""
    least = 1000 / per_second
    schema = T.StructType([*df.schema.fields])
    sorted_ = df.withColumns({"_ms": F.unix_millis(F.col(ts).cast("timestamp")), "_key": F.to_json(F.struct(*keys))})
    sorted_ = sorted_.repartition(*keys).sortWithinPartitions(*keys, *_order(ts, list(order)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0.0
        for batch in batches:
            keep = []
            for key, ms in zip(batch.column("_key").to_pylist(), batch.column("_ms").to_pylist(), strict=True):
                take = key != now or ms - last >= least
                if take:
                    now, last = key, ms
                keep.append(take)
            yield batch.select(schema.names).filter(pa.array(keep, pa.bool_()))

    return sorted_.mapInArrow(work, schema)


def xor_bytes(raw: Column) -> Column:
    """Exclusive or of all bytes, seven at a time; zeros fill the last group and change nothing."""
    groups = F.regexp_extract_all(F.concat(F.hex(raw), F.lit("0" * 12)), F.lit("[0-9A-F]{14}"), F.lit(0))
    folded = F.aggregate(groups, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(F.conv(x, 16, 10).cast("bigint")))
    once = F.array(folded)  # named, so that the fold isn't computed for each of its bytes
    return F.element_at(F.transform(once, lambda v: _bytes_of(v)), 1)


def _bytes_of(v: Column) -> Column:
    out = F.shiftright(v, 48)
    for k in range(0, 48, 8):
        out = out.bitwiseXOR(F.shiftright(v, k))
    return out.bitwiseAND(255).cast("int")


def reassemble(df: DataFrame, keys: list[str], ts: str = "ts", ttl_ms: int = TTL_MS, order: list[str] = (), last: list[str] = (), sums: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """Joined payloads of symbols with a header (index, total, parity), text and bytes; one row for each sighting that completes.

    Parts meet by keys, total and parity; the latest of an index counts; a pause of more than ttl_ms drops them.
    Headers with total < 2 or index >= total give nothing, and wrong parity withholds. Rows without header pass.
    Columns named in `last` come from the part with the last index; those in `sums` are added up, and those in `lists`
    (JSON arrays) joined in order, over all parts; all others are the sighting's.
    """
    bucket = [*keys, "total", "parity"]
    whole = df.filter(F.col("total").isNull())
    parts = df.filter((F.col("total") >= 2) & (F.col("index") < F.col("total")))
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    line = Window.partitionBy(*bucket).orderBy(*_order(ts, list(order)))
    parts = parts.withColumn("_gap", F.coalesce((ms - F.lag(ms).over(line) > ttl_ms).cast("int"), F.lit(0)))
    parts = parts.withColumns({"_n": F.row_number().over(line), "_session": F.sum("_gap").over(line.rowsBetween(Window.unboundedPreceding, 0)), "_x": xor_bytes(F.col("bytes"))})
    # the windows hold numbers only: which row was the latest of each index; the payloads are joined for what completes
    upto = Window.partitionBy(*bucket, "_session").orderBy(*_order(ts, list(order))).rowsBetween(Window.unboundedPreceding, 0)
    slots = [F.last(F.when(F.col("index") == i, F.struct("_n", "_x")), ignorenulls=True).over(upto) for i in range(PARTS)]
    seen = parts.withColumn("_slots", F.slice(F.array(*slots), F.lit(1), F.col("total")))
    good = F.forall("_slots", lambda p: p.isNotNull()) & (F.aggregate("_slots", F.lit(0), lambda a, p: a.bitwiseXOR(p["_x"])) == F.col("parity"))
    own = [c for c in df.columns if c not in ("text", "bytes", *last, *sums, *lists)]
    taken = ["text", "bytes", *last, *sums, *lists]
    done = seen.filter(good).select(*[F.col(c).alias(f"_{c}") for c in bucket], F.col("_n").alias("_at"), F.struct(*own).alias("_own"), F.posexplode("_slots").alias("_place", "_slot"))
    done = done.withColumn("_own", F.when(F.col("_place") == 0, F.col("_own"))).withColumn("_row", F.col("_slot._n"))
    same = F.col("_row") == F.col("_n")
    for c in bucket:
        same &= F.col(f"_{c}").eqNullSafe(F.col(c))
    met = done.join(parts.select(*bucket, "_n", F.struct(*taken).alias("_part")), same)
    rows = met.groupBy(*[f"_{c}" for c in bucket], "_at").agg(F.first("_own", ignorenulls=True).alias("_own"), F.array_sort(F.collect_list(F.struct("_place", "_part"))).alias("_parts"))
    rows = rows.withColumn("_parts", F.transform("_parts", lambda p: p["_part"]))
    each = lambda c: F.transform("_parts", lambda p: p[c])
    joined = {"text": F.array_join(each("text"), ""), "bytes": F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["bytes"])), ""))}
    joined |= {c: F.element_at("_parts", -1)[c] for c in last}
    joined |= {c: F.aggregate(each(c), F.lit(0).cast(df.schema[c].dataType), lambda a, v: a + F.coalesce(v, F.lit(0)).cast(df.schema[c].dataType)) for c in sums}
    inner = lambda c: F.filter(F.transform("_parts", lambda p: F.substring(p[c], F.lit(2), F.length(p[c]) - 2)), lambda t: t != "")
    joined |= {c: F.concat(F.lit("["), F.array_join(inner(c), ","), F.lit("]")) for c in lists}
    out = rows.select(*[joined[c].alias(c) if c in joined else F.col(f"_own.`{c}`").alias(c) for c in df.columns])
    return out.unionByName(whole.select(out.columns))


#: How late rows of a stream may come before their key's state may be gone.
LATE = "1 minute"


def _stateful(df: DataFrame, keys: list[str], ts: str, late: str | None, state: str, step) -> DataFrame:
    """step(key, rows in order, state, until) for the groups of a stream; until(ms) keeps the state to that time of the watermark.

    The times are those of the rows, so a key that comes no more is forgotten once its state can't matter for any row
    that is in time. late=None takes the stream's own watermark.
    """
    rows = df.withWatermark(ts, late) if late else df

    def work(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return

        def until(ms: int, value: tuple) -> None:
            if ms > held.getCurrentWatermarkMs():
                held.update(value)
                held.setTimeoutTimestamp(int(ms))
            elif held.exists:
                held.remove()

        yield step(key, pd.concat(list(frames)), held.get if held.exists else None, until)

    return rows.groupBy(*keys).applyInPandasWithState(work, df.schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def _in_order(part: pd.DataFrame, ts: str, order: list[str]) -> tuple[pd.DataFrame, pd.Series]:
    part = part.sort_values([ts, *order], kind="stable")
    return part, part[ts].astype("datetime64[ms]").astype("int64")


def deduplicate_stream(df: DataFrame, keys: list[str], ts: str = "ts", window_ms: int = WINDOW_MS, order: list[str] = (), late: str | None = LATE) -> DataFrame:
    """The sightings of a stream that deduplicate() would emit; state is the last sighting of each key, for its window.

    Rows that come after later ones of their key, but in time, count as sightings and don't turn the key's clock back.
    """
    columns = df.columns
    if window_ms <= 0:
        return df

    def step(_: tuple, part: pd.DataFrame, state: tuple | None, until) -> pd.DataFrame:
        last = state and state[0]
        part, ms = _in_order(part, ts, list(order))
        before = np.maximum.accumulate(ms.to_numpy())
        gap = np.concatenate([[window_ms if last is None else ms.iloc[0] - last], ms.to_numpy()[1:] - np.maximum(before[:-1], -(1 << 62) if last is None else last)])
        end = int(before[-1]) if last is None else max(int(before[-1]), last)
        until(end + window_ms, (end,))
        return part[gap >= window_ms][columns]

    return _stateful(df, keys, ts, late, "last bigint", step)


def throttle_stream(df: DataFrame, keys: list[str], per_second: float, ts: str = "ts", order: list[str] = (), late: str | None = LATE) -> DataFrame:
    """The rows of a stream that throttle() would take; state is the last row taken of each key, until the next may be."""
    columns, least = df.columns, 1000 / per_second

    def step(_: tuple, part: pd.DataFrame, state: tuple | None, until) -> pd.DataFrame:
        last = state and state[0]
        part, ms = _in_order(part, ts, list(order))
        times, keep, at = ms.to_numpy(), np.zeros(len(ms), bool), 0
        while at < len(times):  # from one taken row to the next, past all between
            at += int(np.searchsorted(times[at:], times[at] if last is None else last + least))
            if at < len(times):
                keep[at], last = True, int(times[at])
                at += 1
        until(int(last + least) + 1, (last,))
        return part[keep][columns]

    return _stateful(df, keys, ts, late, "last bigint", step)


def first_stream(df: DataFrame, keys: list[str], ts: str = "ts", order: list[str] = ()) -> DataFrame:
    """The first row of each key of a stream, ever; state is that there was one, and stays: a number for each scanner."""
    columns = df.columns

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(frames)).sort_values([ts, *order], kind="stable")[columns]
        yield part.iloc[: 0 if state.exists else 1]
        state.update((1,))

    return df.groupBy(*keys).applyInPandasWithState(step, df.schema, "done int", "append", GroupStateTimeout.NoTimeout)


def first(df: DataFrame, keys: list[str], ts: str = "ts", order: list[str] = ()) -> DataFrame:
    """The first row of each key of a table."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(ts, list(order))))
    return df.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def reassemble_stream(df: DataFrame, keys: list[str], ts: str = "ts", ttl_ms: int = TTL_MS, order: list[str] = (), last: list[str] = (), sums: list[str] = (), lists: list[str] = (), late: str | None = LATE) -> DataFrame:
    """reassemble() for a stream; state is the latest part of each index, for ttl_ms. Columns in `last` are numbers or texts."""
    columns, names = df.columns, [*last, *sums, *lists]

    def step(_: tuple, part: pd.DataFrame, state: tuple | None, until) -> pd.DataFrame:
        if part["total"].isna().all():  # total is a key: these have no header
            return part[columns]
        seen, end = (json.loads(state[0]), state[1]) if state else ({}, None)
        out = []
        part, ms = _in_order(part, ts, list(order))
        for row, t in zip(part.to_dict("records"), ms.tolist(), strict=True):
            if row["total"] < 2 or row["index"] >= row["total"]:
                continue
            if end is not None and t - end > ttl_ms:
                seen = {}
            end = t if end is None else max(t, end)
            seen[str(int(row["index"]))] = [row["text"], bytes(row["bytes"]).hex(), {c: row[c] for c in names}]
            got = [seen.get(str(i)) for i in range(int(row["total"]))]
            if all(got):
                raw = b"".join(bytes.fromhex(g[1]) for g in got)
                if int(np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8), initial=0)) == row["parity"]:
                    made = {c: got[-1][2][c] for c in last} | {c: sum(g[2][c] or 0 for g in got) for c in sums}
                    made |= {c: "[" + ",".join(x for g in got if (x := g[2][c][1:-1])) + "]" for c in lists}
                    out.append(row | made | {"text": "".join(g[0] for g in got), "bytes": raw})
        if end is not None:
            until(end + ttl_ms + 1, (json.dumps(seen), end))
        return pd.DataFrame(out, columns=columns)

    return _stateful(df, [*keys, "total", "parity"], ts, late, "parts string, last bigint", step)
