"""Frames, time codes and exact rounding on integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_millis(ts: Column) -> Column:
    """Milliseconds of a time stamp's wall clock, whatever the session time zone."""
    return F.unix_millis(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def div(a: Column, b: Column | int) -> Column:
    """Integer division of non-negative operands."""
    divisor = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("bigint"), divisor.cast("bigint"))


def frame_half_up(ms: Column, fps_num: Column | int = 30, fps_den: Column | int = 1) -> Column:
    """Nearest frame, halves up, on the exact fraction ``ms * num / (1000 * den)``."""
    num = fps_num if isinstance(fps_num, Column) else F.lit(fps_num)
    den = fps_den if isinstance(fps_den, Column) else F.lit(fps_den)
    return div(ms * 2 * num + den * 1000, den * 2000)


def frame_floor(ms: Column, fps: int = 30) -> Column:
    return div(ms * fps, 1000)


def frame_ceil(ms: Column, fps: int = 30) -> Column:
    return div(ms * fps + 999, 1000)


def ticks_inward(frame_in: Column, frame_out: Column, scale: int, fps: int = 30) -> tuple[Column, Column]:
    """Start rounded up and end rounded down to ``scale`` ticks per second."""
    return div(frame_in * scale + (fps - 1), fps), div(frame_out * scale, fps)


def digits(value: Column, width: int = 2) -> Column:
    """A non-negative number with leading zeros to ``width`` digits; a format string costs many times as much a row."""
    text = value.cast("string")
    return F.when(value >= 10 ** (width - 1), text).otherwise(F.lpad(text, width, "0"))


def _below(value: Column, width: int = 2) -> Column:
    """``digits`` of a number that has at most ``width`` digits, in little code: a row of many such stays compiled."""
    return F.substring((value + 10 ** width).cast("string"), 2, width)


def clock(ticks: Column, scale: int) -> Column:
    """``HH:MM:SS,mmm`` for 1000 ticks per second, ``H:MM:SS.cc`` for 100."""
    whole = div(ticks, scale)
    hours, point, places = (digits(div(whole, 3600)), ",", 3) if scale == 1000 else (div(whole, 3600).cast("string"), ".", 2)
    return F.concat(hours, F.lit(":"), _below(div(whole % 3600, 60)), F.lit(":"), _below(whole % 60), F.lit(point), _below(ticks % scale, places))


def timecode(frame: Column, fps: int = 30) -> Column:
    """``HH:MM:SS:FF`` of a frame number."""
    whole = div(frame, fps)
    rest = (_below if fps <= 100 else digits)(frame % fps)
    return F.concat(digits(div(whole, 3600)), F.lit(":"), _below(div(whole % 3600, 60)), F.lit(":"), _below(whole % 60), F.lit(":"), rest)


def timecode_frame(code: Column, fps: int = 30) -> Column:
    """Frame number of ``HH:MM:SS:FF``; null for malformed text or a frame part past the rate."""
    pattern = r"^(\d{2,}):([0-5]\d):([0-5]\d):(\d{2})$"
    # The pattern is matched once; what it lets through is cut at its colons.
    part = [F.split_part(code, F.lit(":"), F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    whole = ((part[0] * 60 + part[1]) * 60 + part[2]) * fps + part[3]
    return F.when(code.rlike(pattern) & (part[3] < fps), whole)


def round6(value: Column) -> Column:
    """Half-even at six places, on the scaled double."""
    return F.rint(value * 1e6) / 1e6


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
