"""Technical indicators per asset. Those without recursion are window columns over one window spec (one shuffle, one sort); the recursive ones share one scan over pieces of the series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallow.functions.windows import BY, guarded, lagged, ordered, rolling
from tallow.operators.series import ROWS, Ewm, Running, numbered, pieces, scan

MIN_ROWS = 200
RECURSIVE = ["rsi_14", "ema_12", "ema_26", "ema_50", "ema_200", "macd", "macd_signal", "macd_histogram", "atr_14"]
WINDOWED = ["roc_10", "roc_20", "stoch_k", "stoch_d", "sma_50", "sma_100", "sma_200", "bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_percentage", "obv", "vwap", "volume_sma_20", "volume_ratio", "returns_1p", "returns_5p", "returns_10p", "returns_20p", "log_returns", "hl_ratio", "close_position"]
PREVIOUS = ["prev_close", "prev_volume", "prev_high", "prev_low"]


def window_indicators(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    w = ordered(by)
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    typical = (h + lo + c) / 3
    low14, high14 = rolling(F.min, "low", 14, w), rolling(F.max, "high", 14, w)
    mid, std = rolling(F.avg, "close", 20, w), rolling(F.stddev_pop, "close", 20, w)
    out = bars.withColumns({f"_lag{n}": F.lag("close", n).over(w) for n in (1, 5, 10, 20)})
    change = lambda n: F.try_divide(c, F.col(f"_lag{n}")) - 1
    out = out.withColumns(
        {
            "roc_10": change(10) * 100, "roc_20": change(20) * 100, "stoch_k": F.try_divide(100 * (c - low14), high14 - low14),
            **{f"sma_{n}": rolling(F.avg, "close", n, w) for n in (50, 100, 200)},
            "bb_upper": mid + 2 * std, "bb_middle": mid, "bb_lower": mid - 2 * std, "bb_width": F.try_divide(4 * std, mid) * 100, "bb_percentage": F.try_divide(c - (mid - 2 * std), 4 * std),
            "obv": F.sum(F.when(c < F.col("_lag1"), -v).otherwise(v)).over(running), "vwap": F.try_divide(rolling(F.sum, typical * v, 14, w), rolling(F.sum, "volume", 14, w)),
            "volume_sma_20": rolling(F.avg, "volume", 20, w), **{f"returns_{n}p": change(n) for n in (1, 5, 10, 20)},
            "log_returns": F.log(F.try_divide(c, F.col("_lag1"))), "hl_ratio": (h - lo) / guarded(c, 1.0), "close_position": (c - lo) / guarded(h - lo, 1.0),
            "prev_close": F.col("_lag1"), "prev_volume": lagged("volume", w), "prev_high": lagged("high", w), "prev_low": lagged("low", w),
        }
    )
    out = out.withColumns({"stoch_d": rolling(F.avg, "stoch_k", 3, w), "volume_ratio": v / guarded(F.col("volume_sma_20"), 1.0)})
    return out.drop(*[x for x in out.columns if x.startswith("_lag")])


def ewm(x: np.ndarray, alpha: float, least: int = 0) -> np.ndarray:
    """y[t] = (1 - alpha) y[t-1] + alpha x[t] from the first known value on; NaN before `least` known values."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()


def wilder_atr(h: np.ndarray, lo: np.ndarray, c: np.ndarray, n: int = 14) -> np.ndarray:
    """Zero before row n - 1, there the mean of the first n true ranges, then Wilder's recursion."""
    tr = h - lo
    tr[1:] = np.maximum(tr[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(lo[1:] - c[:-1])))
    out = np.zeros(len(c))
    if len(c) >= n:
        out[n - 1 :] = ewm(np.concatenate(([tr[:n].mean()], tr[n:])), 1 / n)
    return out


def recursive_columns(pdf: pd.DataFrame) -> pd.DataFrame:
    """The columns of RECURSIVE of one series in memory."""
    c = pdf["close"].to_numpy(float)
    d = np.diff(c, prepend=np.nan)
    up, down = ewm(np.where(d > 0, d, 0.0), 1 / 14, 14), ewm(np.where(d < 0, -d, 0.0), 1 / 14, 14)
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
    rsi[np.isnan(up)] = np.nan
    ema = {n: ewm(c, 2 / (n + 1), n) for n in (12, 26, 50, 200)}
    macd = ema[12] - ema[26]
    signal = ewm(macd, 2 / 10, 9)
    return pdf.assign(rsi_14=rsi, **{f"ema_{n}": e for n, e in ema.items()}, macd=macd, macd_signal=signal, macd_histogram=macd - signal, atr_14=wilder_atr(pdf["high"].to_numpy(float), pdf["low"].to_numpy(float), c))


_KNOWN = ("close", "high", "low")
_FAST, _SLOW = Ewm(2 / 13, "close"), Ewm(2 / 27, "close")
# x of each recursion is a column of _sources(); the signal starts with the first macd, that of row 26.
WILDER = {"_up": Ewm(1 / 14, "_gain"), "_down": Ewm(1 / 14, "_loss"), "_atr": Ewm(1 / 14, "_range", 14)}
FEATURE_SCAN = {"ema_12": _FAST, "ema_26": _SLOW, "ema_50": Ewm(2 / 51, "close"), "ema_200": Ewm(2 / 201, "close"), "macd_signal": Ewm(0.2, ("ema_12", "ema_26"), 26), **WILDER}
DASHBOARD_SCAN = {"ema_dash_9": Ewm(2 / 10, "close"), "ema_dash_21": Ewm(2 / 22, "close"), "ema_dash_50": Ewm(2 / 51, "close"), "_fast": _FAST, "_slow": _SLOW, "macd_dash_signal": Ewm(0.2, ("_fast", "_slow"))}
DASHBOARD = ["ema_dash_9", "ema_dash_21", "ema_dash_50", "macd_dash", "macd_dash_signal", "macd_dash_histogram"]


def _is_known() -> Column:
    out = F.lit(True)
    for c in _KNOWN:
        out = out & F.col(c).isNotNull() & ~F.isnan(c)
    return out


def _sources(p: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Gain, loss and range of each row of pieces (the range of row 14 is the mean of the first 14), from the row before."""
    w = ordered((*by, "piece"), "row_no")
    before = F.lag("close").over(w)
    h, lo, d = F.col("high"), F.col("low"), F.col("close") - before
    p = p.withColumns({"_gain": F.coalesce(F.greatest(d, F.lit(0.0)), F.lit(0.0)), "_loss": F.coalesce(F.greatest(-d, F.lit(0.0)), F.lit(0.0)), "_range": F.greatest(h - lo, F.abs(h - before), F.abs(lo - before))})
    return p.withColumn("_range", F.when(F.col("row_no") == 14, F.avg("_range").over(w.rowsBetween(-13, 0))).otherwise(F.col("_range")))


def _from_scan(done: DataFrame) -> DataFrame:
    """The columns of RECURSIVE from those of FEATURE_SCAN; NULL in the rows of their warm-up."""
    n, up, down = F.col("row_no"), F.col("_up"), F.col("_down")
    macd, signal = F.col("ema_12") - F.col("ema_26"), F.when(n >= 34, F.col("macd_signal"))
    out = done.withColumns({"rsi_14": F.when(n >= 14, F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))), "macd": F.when(n >= 26, macd), "macd_signal": signal, "macd_histogram": macd - signal, "atr_14": F.when(F.col("in_halo"), F.lit(None)).otherwise(F.coalesce("_atr", F.lit(0.0)))})
    return out.withColumns({f"ema_{x}": F.when(n >= x, F.col(f"ema_{x}")) for x in (12, 26, 50, 200)})


def _of_known_rows(bars: DataFrame, by: tuple[str, ...], names: list[str], solve) -> DataFrame:
    """bars with the columns `names` of solve(numbered rows); rows without a close, high or low have no part in the recursion and NULLs there."""
    keep = bars.select(*[c for c in bars.columns if c not in names])
    done = solve(numbered(keep.where(_is_known()), by)).where(~F.col("in_halo")).select(*keep.columns, *names)
    return done.unionByName(keep.where(~_is_known()), allowMissingColumns=True)


def recursive_indicators(bars: DataFrame, by: tuple[str, ...] = BY, size: int = ROWS) -> DataFrame:
    """EMA, Wilder and MACD columns, as of recursive_columns. Series are cut into pieces of `size` rows (200 or more), so no task holds a whole one."""
    return _of_known_rows(bars, by, RECURSIVE, lambda n: _from_scan(scan(_sources(pieces(n, 13, size), by), FEATURE_SCAN, by, size=size)))


HALO = 219  # rows that the longest window, a mean of 200, and a mean over means need


def features(gold: DataFrame, by: tuple[str, ...] = BY, min_rows: int = MIN_ROWS, size: int = ROWS) -> DataFrame:
    """The feature table: groups of at least min_rows, all indicators, rows of the warm-up dropped. Windows see pieces of a series with HALO rows before them."""
    keep = [c for c in gold.columns if c not in RECURSIVE]
    p = _sources(pieces(numbered(gold.select(*keep).where(_is_known()), by).where(F.col("n_rows") >= min_rows), HALO, size), by)
    signed = F.when(F.col("close") < F.lag("close").over(ordered((*by, "piece"), "row_no")), -F.col("volume")).otherwise(F.col("volume"))
    done = _from_scan(scan(p.withColumn("_signed", signed), FEATURE_SCAN | {"_obv": Running("sum", "_signed")}, by, size=size))
    done = window_indicators(done.select(*keep, *RECURSIVE, "_obv", "piece", "in_halo"), (*by, "piece"))
    done = done.where(~F.col("in_halo")).withColumn("obv", F.col("_obv")).drop("_obv", "piece", "in_halo")
    return done.na.drop(subset=RECURSIVE + WINDOWED)


def class_features(features: DataFrame, extras: DataFrame, asset_class: str) -> DataFrame:
    """The feature table of one class; that of crypto has turnover, open interest and funding of the same bar where they exist."""
    own = features.where(F.lower("asset_class") == asset_class.lower())
    keys = ["asset_symbol", "interval", "date"]
    return own.join(extras.select(*keys, "turnover", "open_interest", "funding_rate"), keys, "left") if asset_class.lower() == "crypto" else own


def dashboard_recursive(bars: DataFrame, by: tuple[str, ...] = BY, size: int = ROWS) -> DataFrame:
    """The dashboard's exponential means, defined from the first row on: ema_dash_9/21/50, macd_dash, its signal and histogram."""

    def solve(n: DataFrame) -> DataFrame:
        done = scan(pieces(n, 0, size), DASHBOARD_SCAN, by, size=size)
        macd = F.col("_fast") - F.col("_slow")
        return done.withColumns({"macd_dash": macd, "macd_dash_histogram": macd - F.col("macd_dash_signal")})

    return _of_known_rows(bars, by, DASHBOARD, solve)


def dashboard_indicators(bars: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """The dashboard's formulas under names of their own: simple-mean RSI and ATR, sample Bollinger, cumulative VWAP, signed OBV."""
    w = ordered(by)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    b = bars.withColumns({"_p": lagged("close", w), "_n": F.row_number().over(w)}).withColumn("_d", c - F.col("_p"))
    gain, loss = rolling(F.avg, F.greatest(F.col("_d"), F.lit(0.0)), 14, w), rolling(F.avg, F.greatest(-F.col("_d"), F.lit(0.0)), 14, w)
    gain, loss = (F.when(F.col("_d").isNotNull() & (F.col("_n") > 14), x) for x in (gain, loss))
    true_range = F.greatest(h - lo, F.abs(h - F.col("_p")), F.abs(lo - F.col("_p")))
    mid, std = rolling(F.avg, "close", 20, w), rolling(F.stddev_samp, "close", 20, w)
    out = b.withColumns(
        {
            "rsi_sma_14": 100 - 100 / (1 + gain / guarded(loss, 1e-10)), "atr_sma_14": rolling(F.avg, true_range, 14, w), "bb_samp_upper": mid + 2 * std, "bb_samp_lower": mid - 2 * std,
            "vwap_cum": F.sum((h + lo + c) / 3 * v).over(running) / guarded(F.sum("volume").over(running), 1.0), "obv_sign": F.sum(F.coalesce(F.signum("_d") * v, F.lit(0.0))).over(running),
        }
    )
    return out.drop("_p", "_n", "_d")
