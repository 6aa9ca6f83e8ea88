"""Indicators candle by candle: a stream of candles with the recursions' state of each series kept from batch to batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tallow.functions.windows import BY
from tallow.operators.indicators import RECURSIVE

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
# With an expiry, a query that is to stop once it has read what is there (availableNow) needs this too: else it waits for the clock in batches without rows.
NO_IDLE_BATCHES = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
PRICES = ("high", "low", "close")
EMAS = {"ema_12": 12, "ema_26": 26, "ema_50": 50, "ema_200": 200}
FIELDS = ["close", *EMAS, "signal", "up", "down", "atr"]
STATE = "n long, last timestamp, " + ", ".join(f"{x} double" for x in FIELDS)
NAMES = ["n", "last", *FIELDS]


def step(s: dict | None, high: float, low: float, close: float) -> dict:
    """The state after one more candle; None is the state before the first."""
    if s is None:
        return {"n": 1, "close": close, **dict.fromkeys(EMAS, close), "signal": math.nan, "up": 0.0, "down": 0.0, "atr": high - low}
    n, change = s["n"] + 1, close - s["close"]
    out = {"n": n, "close": close} | {name: s[name] + 2 / (span + 1) * (close - s[name]) for name, span in EMAS.items()}
    out["up"] = s["up"] + (max(change, 0.0) - s["up"]) / 14
    out["down"] = s["down"] + (max(-change, 0.0) - s["down"]) / 14
    true_range = max(high - low, abs(high - s["close"]), abs(low - s["close"]))
    # The mean of the first 14 ranges, then Wilder's: both are steps towards the new range.
    out["atr"] = s["atr"] + (true_range - s["atr"]) / min(n, 14)
    macd = out["ema_12"] - out["ema_26"]
    out["signal"] = macd if n == 26 else s["signal"] + 0.2 * (macd - s["signal"])
    return out


def shown(s: dict) -> dict:
    """The columns of RECURSIVE of a state; none in its warm-up."""
    n, out = s["n"], {name: s[name] if s["n"] >= span else None for name, span in EMAS.items()}
    if n >= 14:
        out["rsi_14"] = 100.0 if s["down"] == 0 else 100 - 100 / (1 + s["up"] / s["down"])
    if n >= 26:
        out["macd"] = s["ema_12"] - s["ema_26"]
    if n >= 34:
        out |= {"macd_signal": s["signal"], "macd_histogram": out["macd"] - s["signal"]}
    return {c: out.get(c) for c in RECURSIVE} | {"atr_14": s["atr"] if n >= 14 else 0.0}


class CandleIndicators(StatefulProcessor):
    """Keeps one state a series; it expires when no candle has come for ttl_ms of processing time."""

    def __init__(self, by: tuple[str, ...], ttl_ms: int | None) -> None:
        self.by, self.ttl_ms = by, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE, self.ttl_ms) if self.ttl_ms else handle.getValueState("series", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        s = dict(zip(NAMES, held, strict=True)) if held is not None else None
        last = pd.Timestamp(s["last"]) if s else pd.Timestamp.min
        new = pd.concat(list(rows), ignore_index=True).dropna(subset=["date", *PRICES]).sort_values(["date", *PRICES], ignore_index=True)
        out = []
        for date, high, low, close in zip(new["date"], *(new[c].astype(float) for c in PRICES), strict=True):
            if date <= last:
                continue
            s, last = step(s, high, low, close), date
            out.append({**dict(zip(self.by, key, strict=True)), "date": date, "close": close, **shown(s)})
        if out:
            self.state.update((s["n"], last.to_pydatetime(), *[float(s[x]) for x in FIELDS]))
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_indicators(candles: DataFrame, by: tuple[str, ...] = BY, ttl_ms: int | None = None) -> DataFrame:
    """by, date, close and RECURSIVE of each candle of a stream, as the batch has them.

    A series' candles come in time order from batch to batch (in any order within one); one at or before the last seen, or without
    a price, is left out. The state of a series is ten numbers. The session needs the settings ROCKS.
    """
    rows = candles.select(*by, "date", *PRICES)
    schema = StructType([*[rows.schema[c] for c in by], rows.schema["date"], rows.schema["close"]])
    for c in RECURSIVE:
        schema = schema.add(c, "double")
    mode = "ProcessingTime" if ttl_ms else "None"
    return rows.groupBy(*by).transformWithStateInPandas(CandleIndicators(by, ttl_ms), outputStructType=schema, outputMode="append", timeMode=mode)
