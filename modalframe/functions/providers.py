"""Extension points: modal-fitting providers and per-realisation runners."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modalframe.operators import frf

_PROVIDERS: dict[str, Callable[..., DataFrame]] = {}


def register_provider(name: str):
    """Register ``fn(frf_lines, **options) -> shapes DataFrame`` as a modal-fitting provider."""

    def wrap(fn):
        if name in _PROVIDERS:
            raise ValueError(f"provider {name!r} is already registered")
        _PROVIDERS[name] = fn
        return fn

    return wrap


def fit_modes(name: str, lines: DataFrame, **options) -> DataFrame:
    """Run a registered provider; an unknown name is refused."""
    if name not in _PROVIDERS:
        raise KeyError(f"unknown modal-fitting provider {name!r}; registered: {', '.join(sorted(_PROVIDERS))}")
    return _PROVIDERS[name](lines, **options)


@register_provider("frf_peaks")
def frf_peaks(lines: DataFrame, coherence: DataFrame | None = None) -> DataFrame:
    """Peak-derived shapes: indicator, smoothing, peaks, the best forty, channel values at the peak lines."""
    smooth = frf.smooth_indicator(frf.indicator(lines, coherence))
    return frf.peak_shapes(frf.rank_peaks(frf.find_peaks(smooth)), lines)


def run_realisations(draws: DataFrame, keys: list[str], runner: Callable[[pd.DataFrame], dict[str, float]], outputs: list[str]) -> DataFrame:
    """Call ``runner`` once per realisation (the few rows of one key) and keep failures as text instead of failing the job."""
    schema = T.StructType([draws.schema[k] for k in keys] + [T.StructField(o, T.DoubleType()) for o in outputs] + [T.StructField("failure", T.StringType())])

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: pdf[k].iloc[0] for k in keys}
        try:
            found = runner(pdf)
            row |= {o: float(found[o]) for o in outputs} | {"failure": None}
        except (ValueError, RuntimeError, ArithmeticError, KeyError) as error:
            row |= {o: None for o in outputs} | {"failure": f"{type(error).__name__}: {error}"}
        return pd.DataFrame([row])

    return draws.groupBy(*keys).applyInPandas(call, schema)


def realisation_summary(results: DataFrame, outputs: list[str]) -> DataFrame:
    """Success and failure counts with the mean of every output."""
    ok = F.col("failure").isNull()
    return results.agg(F.sum(ok.cast("int")).alias("n_ok"), F.sum((~ok).cast("int")).alias("n_failed"), *[F.avg(o).alias(o) for o in outputs])
