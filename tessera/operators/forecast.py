"""ARIMA forecasts, one series to a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Most AR, MA and differencing orders; months that a series needs; the normal quantile of a 95 % interval.
P, Q, D, LEAST, Z = 3, 3, 2, 12, 1.959963984540054


def differences(y: np.ndarray) -> int:
    """How often to difference: until the KPSS statistic of level stationarity is below its 5 % value, 0.463."""
    for d in range(D + 1):
        e = np.diff(y, d) - np.diff(y, d).mean()
        n, s = len(e), np.cumsum(e)
        lags = int(12 * (n / 100) ** 0.25)
        var = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, min(lags, n - 1) + 1))) / n
        if var <= 0 or (s @ s) / n**2 / var < 0.463:
            return d
    return D


def residuals(w: np.ndarray, c: float, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """One-step errors of an ARMA model, with zeros before the start."""
    e = np.zeros(len(w))
    for t in range(len(w)):
        guess = c + sum(a * w[t - 1 - i] for i, a in enumerate(ar) if t > i) + sum(m * e[t - 1 - i] for i, m in enumerate(ma) if t > i)
        e[t] = w[t] - guess
    return e


def fit(w: np.ndarray, p: int, q: int) -> tuple[np.ndarray, float] | None:
    """(constant, AR, MA coefficients) and AIC, by Gauss-Newton steps on the conditional sum of squares; None where it runs away."""
    theta = np.zeros(1 + p + q)
    theta[0] = w.mean()
    errors = lambda t: residuals(w, t[0], t[1 : 1 + p], t[1 + p :])
    e = errors(theta)
    for _ in range(25):
        if not np.isfinite(e).all():
            return None
        step = 1e-6
        jac = np.stack([(errors(theta + step * unit) - e) / step for unit in np.eye(len(theta))], axis=1)
        move = np.linalg.lstsq(jac, -e, rcond=None)[0]
        for scale in (1.0, 0.5, 0.25, 0.1, 0.02):
            trial = theta + scale * move
            other = errors(trial)
            if np.isfinite(other).all() and other @ other < e @ e and np.abs(trial[1:]).sum() < 2 * (p + q) + 1:
                break
        else:
            break
        done = (e @ e) - (other @ other) < 1e-10 * (e @ e)
        theta, e = trial, other
        if done:
            break
    n = len(w)
    return theta, n * np.log(max(e @ e / n, 1e-300)) + 2 * (len(theta) + 1)


def auto_arima(y: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(p, d, q, coefficients) of the least AIC, by steps from (2, 2), (0, 0), (1, 0) and (0, 1) to better neighbours."""
    d = differences(y)
    w = np.diff(y, d)
    tried: dict[tuple[int, int], tuple[np.ndarray, float] | None] = {}

    def cost(o: tuple[int, int]) -> float:
        if o not in tried:
            tried[o] = fit(w, *o)
        return tried[o][1] if tried[o] else np.inf

    best = min([(2, 2), (0, 0), (1, 0), (0, 1)], key=cost)
    while True:
        around = [(best[0] + i, best[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= best[0] + i <= P and 0 <= best[1] + j <= Q]
        better = min(around, key=cost)
        if cost(better) >= cost(best):
            return best[0], d, best[1], tried[best][0]
        best = better


def forecast(y: np.ndarray, periods: int = 12) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(order, fitted values, forecasts, standard errors)."""
    p, d, q, theta = auto_arima(y)
    c, ar, ma = theta[0], theta[1 : 1 + p], theta[1 + p :]
    w = np.diff(y, d)
    e = residuals(w, c, ar, ma)
    fitted = np.concatenate([np.full(d, np.nan), y[d:] - e])
    fitted[:d] = y[:d]
    w, e = w.tolist(), e.tolist()
    sigma = float(np.sqrt(np.mean(np.square(e))))
    for _ in range(periods):
        w.append(c + sum(a * w[-1 - i] for i, a in enumerate(ar) if i < len(w)) + sum(m * e[-1 - i] for i, m in enumerate(ma) if i < len(e)))
        e.append(0.0)
    ahead = np.array(w[-periods:])
    for k in range(d, 0, -1):
        ahead = np.diff(y, k - 1)[-1] + np.cumsum(ahead)
    psi = [1.0]
    for j in range(1, periods):
        psi.append((ma[j - 1] if j <= q else 0.0) + sum(a * psi[j - 1 - i] for i, a in enumerate(ar) if j - 1 - i >= 0))
    weights = np.array(psi)
    for _ in range(d):
        weights = np.cumsum(weights)
    return f"({p},{d},{q})", fitted, ahead, sigma * np.sqrt(np.cumsum(weights**2))


def arima(series: DataFrame, by: str, month: str, value: str, periods: int = 12) -> DataFrame:
    """(by, kind, ds, y, yhat, yhat_lower, yhat_upper, arima_order): fitted rows, then forecasts from the month after the last.

    Every series is one group of at most some hundred months; one that is too short or cannot be fitted gives no rows.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(month)
        y = pdf[value].to_numpy(dtype=float)
        columns = [by, "kind", "ds", "y", "yhat", "yhat_lower", "yhat_upper", "arima_order"]
        if len(y) < LEAST:
            return pd.DataFrame(columns=columns)
        try:
            order, fitted, ahead, error = forecast(y, periods)
        except np.linalg.LinAlgError:
            return pd.DataFrame(columns=columns)
        last = pd.Timestamp(pdf[month].iloc[-1])
        months = [(last + pd.DateOffset(months=i)).date() for i in range(1, periods + 1)]
        name = pdf[by].iloc[0]
        past = pd.DataFrame({by: name, "kind": "fitted", "ds": pdf[month].tolist(), "y": y, "yhat": fitted, "yhat_lower": np.nan, "yhat_upper": np.nan, "arima_order": order})
        future = pd.DataFrame({by: name, "kind": "forecast", "ds": months, "y": np.nan, "yhat": ahead, "yhat_lower": ahead - Z * error, "yhat_upper": ahead + Z * error, "arima_order": order})
        return pd.concat([past, future])[columns]

    schema = f"{by} string, kind string, ds date, y double, yhat double, yhat_lower double, yhat_upper double, arima_order string"
    return series.select(by, month, value).groupBy(by).applyInPandas(one, schema)
