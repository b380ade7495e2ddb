"""Path and name functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def forward(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.regexp_replace(path, r"\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(forward(path), "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.when(F.contains(forward(path), F.lit("/")), F.regexp_replace(forward(path), "/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


def slug(path: Column, keep: int = 48) -> Column:
    """Characters other than letters, digits, _ and - as _, last ``keep``."""
    return _right(F.regexp_replace(F.coalesce(path, F.lit("")), "[^0-9A-Za-z_-]", "_"), keep)


def _right(text: Column, keep: int) -> Column:
    return F.substring(text, F.greatest(F.length(text) - keep + 1, F.lit(1)), F.lit(keep))



def safe_class_name(name: Column, keep: int = 48) -> Column:
    """Letters, digits and -_. stay, others become _, first ``keep``; nothing left: ``unknown``."""
    clean = F.substring(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}._-]", "_"), 1, keep)
    return F.when(clean == "", F.lit("unknown")).otherwise(clean)


def like_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` of ``whole`` (neither negative) in per cent with up to three digits, rounded as C and Python round: by the double's exact value, ties to even.

    Java's formats round the double's shortest decimal text instead, which is another number in a tenth of all shares of 10,000.  Here the
    fraction is taken as a whole number of 2^-73, in two parts.
    """
    scale, low = 10**digits, 1 << 20
    x = (100 * part).cast("double") / whole.cast("double")
    fraction = (x - F.floor(x)) * float(1 << 53)
    high, rest = F.floor(fraction), F.floor((fraction - F.floor(fraction)) * float(low)) * scale
    units = high * scale + F.shiftright(rest, 20)
    down, left = F.floor(x) * scale + F.shiftright(units, 53), units.bitwiseAND((1 << 53) - 1)
    tie = F.lit(1 << 52)
    up = (left > tie) | ((left == tie) & ((rest % low > 0) | (down % 2 == 1)))
    rounded = down + up.cast("long")
    return F.format_string(f"%d.%0{digits}d%%", F.floor(rounded / scale), rounded % scale)


def hash_bucket(key: Column, buckets: int = 10) -> Column:
    """The first eight hexadecimal digits of the key's MD5 as a number, modulo ``buckets``."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def hash_split(key: Column) -> Column:
    """``val`` for one in ten keys, else ``train``."""
    return F.when(hash_bucket(key) == 0, F.lit("val")).otherwise(F.lit("train"))


def hour_window(ts: Column, spec: str | None) -> Column:
    """Whether the hour is within "a-b" (b excluded, over midnight where a > b); no or bad spec: true."""
    try:
        a, b = (int(x) for x in (spec or "").split("-"))
    except ValueError:
        return F.lit(True)
    h = F.hour(ts)
    return (h >= a) & (h < b) if a <= b else (h >= a) | (h < b)
