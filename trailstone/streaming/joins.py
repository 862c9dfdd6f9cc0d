"""Streams that meet: rows of equal session and step, and the newest row of another stream as of a row's time.

Both wait for each other as long as the watermarks say that something may still come, and no longer: state is bounded by
the rows of that time, and for the as-of join by one row a key besides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def join_steps(left: DataFrame, right: DataFrame, late: str = "10 seconds", apart: str = "10 seconds", keys: Sequence[str] = ("session_id", "step_nr"), ts: str = "ts", how: str = "leftOuter") -> DataFrame:
    """left with the right rows of the same keys whose time is at most `apart` from its own; names of right columns must differ.

    leftOuter: a left row without any comes out, with nulls, once the watermark says that none can come any more. Works on
    tables as on streams, with the same rows.
    """
    l, r = left.withWatermark(ts, late).alias("l"), right.withWatermark(ts, late).alias("r")  # noqa: E741
    on = F.expr(" AND ".join([*(f"l.{k} = r.{k}" for k in keys), f"r.{ts} BETWEEN l.{ts} - INTERVAL {apart} AND l.{ts} + INTERVAL {apart}"]))
    return l.join(r, on, how).select("l.*", *(F.col(f"r.{c}") for c in right.columns if c not in (*keys, ts)))


class _Newest(StatefulProcessor):
    """Rows of both sides wait for the watermark; of the right side's older rows the newest alone stays."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lefts = handle.getMapState("lefts", "us long, row string", "n long")
        self.rights = handle.getMapState("rights", "us long", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for us, side, row, value in zip(batch["us"].tolist(), batch["side"].tolist(), batch["row"].tolist(), batch["value"].tolist(), strict=True):
                expires = -(-int(us) // 1000)
                if expires <= passed:
                    continue  # later than the watermark allows
                if side:
                    at = (int(us), row)
                    n = self.lefts.getValue(at)[0] if self.lefts.containsKey(at) else 0
                    self.lefts.updateValue(at, (n + 1,))
                else:
                    at = (int(us),)
                    held = self.rights.getValue(at)[0] if self.rights.containsKey(at) else value
                    self.rights.updateValue(at, (max(held, value),))
                self.handle.registerTimer(expires)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(tuple(k) for k in self.lefts.keys() if k[0] <= until)
        known = sorted(k[0] for k in self.rights.keys() if k[0] <= until)
        out, i, value = [], -1, None
        for us, row in due:
            while i + 1 < len(known) and known[i + 1] <= us:
                i += 1
                value = self.rights.getValue((known[i],))[0]
            out += [(row, value)] * self.lefts.getValue((us, row))[0]
            self.lefts.removeKey((us, row))
        for old in known[:-1]:
            self.rights.removeKey((old,))
        if out:
            yield pd.DataFrame(out, columns=["row", "value"])

    def close(self) -> None:
        pass


def asof_streams(left: DataFrame, right: DataFrame, by: str, values: Sequence[str], late: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """left with the values of the right stream's newest row at or before its time, of the same `by`; null if there is none.

    Of right rows of one time the greatest counts (by its values' JSON). A left row comes out once the watermark, the
    smaller of both streams', has passed it, whatever the order of arrival. `by` is a string. Needs the RocksDB state store.
    """
    row, value = F.struct(*(F.col(c) for c in left.columns)), F.struct(*(F.col(c) for c in values))
    kinds = {"row": left.select(row.alias("row")).schema["row"].dataType, "value": right.select(value.alias("value")).schema["value"].dataType}
    options = {"ignoreNullFields": "false"}
    lefts = left.withWatermark(ts, late).select(F.col(by).alias("key"), F.col(ts).alias("at"), F.unix_micros(ts).alias("us"), F.lit(True).alias("side"), F.to_json(row, options).alias("row"), F.lit(None).cast("string").alias("value"))
    rights = right.withWatermark(ts, late).select(F.col(by).alias("key"), F.col(ts).alias("at"), F.unix_micros(ts).alias("us"), F.lit(False).alias("side"), F.lit(None).cast("string").alias("row"), F.to_json(value, options).alias("value"))
    met = lefts.unionByName(rights).groupBy("key").transformWithStateInPandas(_Newest(), "row string, value string", "append", "eventTime")
    read = met.select(F.from_json("row", kinds["row"]).alias("row"), F.from_json("value", kinds["value"]).alias("value"))
    return read.select("row.*", *(F.col(f"value.{v}").alias(v) for v in values))
