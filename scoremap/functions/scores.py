"""Scores to bins, colours and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoremap.sources.literals import PALETTE


def palette() -> Column:
    return F.array(*[F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b")) for r, g, b in PALETTE])


def known(score: Column) -> Column:
    """NaN is a missing score."""
    return F.when(~F.isnan(score), score)


def minmax(x: Column, low: Column, high: Column) -> Column:
    """Null where all values are equal."""
    return F.try_divide(x - low, high - low)


def ramp_index(score: Column, n: int = len(PALETTE)) -> Column:
    """Bin floor(score * (n - 1)): only a score of 1 reaches the last bin."""
    return F.floor(known(score) * (n - 1)).cast("int")


def ramp_index_scaled(score: Column, n: int = len(PALETTE), gain: float = 2.5, clamp: bool = False) -> Column:
    """The bin of a score times a gain; beyond the last bin there is no colour, or
    the last bin with ``clamp``."""
    i = F.floor(known(score) * gain * (n - 1)).cast("int")
    return F.least(i, F.lit(n - 1)) if clamp else i


def colour(index: Column) -> Column:
    """The palette entry, null outside the palette."""
    return F.when(index >= 0, F.get(palette(), index))


def rgb_css(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("rgb(%d,%d,%d)", c["r"], c["g"], c["b"]))


def percent_label(score: Column, zero_is_missing: bool = False) -> Column:
    """Null for a missing score, and for 0 with ``zero_is_missing``."""
    s = known(score)
    shown = s.isNotNull() & (s != 0) if zero_is_missing else s.isNotNull()
    return F.when(shown, F.format_string("Score: %.1f%%", s * 100))


def hover_label(layer: Column, name: Column, score: Column) -> Column:
    """What a feature shows under the pointer: a deployment its name, if it has one, a
    sidewalk its score, unless that is missing or 0, and any other layer nothing."""
    return F.when((layer == "deployments") & (name != ""), name).when(layer == "sidewalks", percent_label(score, zero_is_missing=True))


def default_score(score: Column) -> Column:
    return F.coalesce(known(score), F.lit(0.0))


def opacity(i: Column, n: int) -> Column:
    return (1 - i / (n - 1)) * 0.3


def active_colour(item: Column, active: Column) -> Column:
    return F.when(F.coalesce(item == active, F.lit(False)), "green").otherwise("blue")


def embed_url(video: Column, start: Column, end: Column, base: str = "https://www.youtube.com/embed/") -> Column:
    return F.format_string(base + "%s?start=%d&end=%d", video, start, end)
