"""Reproducible random draws computed from keys.

A draw is a pure function of (unit key, stream, replay): a lost executor
recomputes the same arms, and any other engine can check them.  Codes and the
state between code and draw have 64 bits, so no two units of a large table share
their draws.  XXH64 is one code-generated call per draw and builds no strings,
which matters when each unit is re-randomized hundreds of times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0

# One stream per purpose, so the draws of a unit are independent of each other.
STREAMS = {"arm": 1, "lift": 2, "drop": 3, "whale": 4, "base": 5, "sample": 6,
           "boot": 7, "slice": 8, "label": 9, "order": 10, "split": 11}
STREAM_STEP = 100_000_007


def unit_code(key: Column) -> Column:
    """64-bit code of a long key; compute it once per unit, before the unit is
    repeated over replays."""
    return F.xxhash64(key.cast("bigint"))


def draw_sql(stream: str, replay: str | int = 0, code: str = "code") -> str:
    """Uniform integer in [0, 2**32) for a unit code, a stream and a replay."""
    salt = STREAMS[stream] * STREAM_STEP
    step = str(replay + salt) if isinstance(replay, int) else f"CAST({replay} AS INT) + {salt}"
    return f"shiftrightunsigned(xxhash64({code}, {step}), 32)"


def uniform_sql(stream: str, replay: str | int = 0, code: str = "code") -> str:
    """Uniform double in [0, 1)."""
    return f"({draw_sql(stream, replay, code)} / 4294967296D)"


def draw(stream: str, replay: str | int = 0, code: str = "code") -> Column:
    return F.expr(draw_sql(stream, replay, code))


def uniform(stream: str, replay: str | int = 0, code: str = "code") -> Column:
    return F.expr(uniform_sql(stream, replay, code))


def text_bucket(text: Column) -> Column:
    """Bucket in [0, 2**32) of a string, from its MD5; used for salted text keys."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def salted_bucket(salt: str, key: Column) -> Column:
    return text_bucket(F.concat(F.lit(salt), key.cast("string")))
