"""Scalar functions over columns; all stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
OFFICE = ["application/msword", DOCX]
DASH = "—"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def at(now: str) -> Column:
    """A moment, given as text, as a timestamp without zone."""
    return F.lit(now).cast("timestamp_ntz")


def micros(x: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    name = x if isinstance(x, str) else None
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name) if name else x)


def media_kind(mime: Column | str) -> Column:
    m = col(mime)
    out = F.when(F.startswith(m, F.lit("image/")), "image").when(F.startswith(m, F.lit("video/")), "video").when(F.startswith(m, F.lit("audio/")), "audio")
    return out.when(m.isin("application/pdf", *OFFICE), "document").otherwise("other")


def preview_route(mime: Column | str) -> Column:
    """native: shown as it is; generated: needs a rendering; unsupported."""
    m = col(mime)
    native = F.startswith(m, F.lit("image/")) | F.startswith(m, F.lit("video/")) | F.startswith(m, F.lit("audio/")) | (m == "application/pdf")
    return F.when(native, "native").when(m.isin(OFFICE), "generated").otherwise("unsupported")


def has_artifacts(mime: Column | str) -> Column:
    """Whether thumbnails and previews are made of files of this type."""
    m = F.coalesce(col(mime), F.lit("application/octet-stream"))
    return F.startswith(m, F.lit("image/")) | F.startswith(m, F.lit("video/")) | m.isin("application/pdf", "application/msword") | F.contains(m, F.lit("wordprocessingml"))


def extractor_for(mime: Column | str) -> Column:
    kind = media_kind(mime)
    return F.when(kind == "image", "exiftool").when(kind.isin("video", "audio"), "ffprobe").when(kind == "document", "tika").otherwise("generic")


def is_hidden(path: Column | str) -> Column:
    return F.exists(F.split(col(path), "/"), lambda c: F.startswith(c, F.lit(".")))


def is_safe_relative(path: Column | str) -> Column:
    p = col(path)
    return (p != "") & ~F.startswith(p, F.lit("/")) & ~F.array_contains(F.split(p, "/"), "..")


def split_dir_name(path: Column | str) -> Column:
    """dirs (folders above), name."""
    parts = F.split(col(path), "/")
    return F.struct(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("dirs"), F.element_at(parts, -1).alias("name"))


def _number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), F.expr("1").cast("long") * text.try_cast("long"))


def _unsigned(text: Column) -> Column:
    """Digits as an unsigned number of 64 bits; null for others and for larger ones."""
    number = text.try_cast("decimal(38,0)")
    return F.when(text.rlike("^[0-9]+$") & (number <= F.lit(str(2**64 - 1)).cast("decimal(38,0)")), number)


def parse_byte_range(header: Column | str, total: Column | str) -> Column:
    """start, end, length of a single range `bytes=a-b`, `a-` or `-n` of a file of `total` bytes; null if invalid, also for numbers beyond 64 bits."""
    h, n = col(header), col(total).cast("decimal(38,0)")
    ok = h.rlike("^bytes=([0-9]+-[0-9]*|-[0-9]+)$")
    texts = [F.regexp_extract(h, pattern, 1) for pattern in ("^bytes=([0-9]*)-", "-([0-9]*)$")]
    first, last = map(_unsigned, texts)
    sound = ((texts[0] == "") | first.isNotNull()) & ((texts[1] == "") | last.isNotNull())
    start = F.when(first.isNull(), F.greatest(n - last, F.lit(0))).otherwise(first)
    end = F.when(first.isNull() | last.isNull(), n - 1).otherwise(F.least(last, n - 1))
    valid = ok & sound & (n > 0) & (start < n) & (end >= start) & (first.isNotNull() | (last > 0)) & (first.isNull() | last.isNull() | (last >= first))
    long = lambda c: c.try_cast("bigint")
    return F.when(valid, F.struct(long(start).alias("start"), long(end).alias("end"), long(end - start + 1).alias("length")))


def parse_content_range(header: Column | str) -> Column:
    """start, end, total (null for *) of `bytes a-b/t`; null if invalid."""
    h = col(header)
    start, end, total = (_number(F.regexp_extract(h, "^bytes ([0-9]+)-([0-9]+)/([0-9]+|[*])$", k)) for k in (1, 2, 3))
    valid = h.rlike("^bytes [0-9]+-[0-9]+/([0-9]+|[*])$") & start.isNotNull() & (end >= start) & (F.endswith(h, F.lit("/*")) | (total > end))
    return F.when(valid, F.struct(start.alias("start"), end.alias("end"), total.alias("total")))


def safe_filename(name: Column | str) -> Column:
    return F.translate(col(name), '\r\n\0"\\', "_____")


def format_size(size: Column | str, kind: Column | str) -> Column:
    """Decimal units, one digit below ten; a dash for folders and unknown sizes. Whole tenths avoid ties that languages round apart."""
    b = col(size)
    out = F.when((col(kind) == "folder") | b.isNull(), F.lit(DASH)).when(b < 1000, F.concat(b.cast("string"), F.lit(" B")))
    for unit, power in (("KB", 3), ("MB", 6), ("GB", 9), ("TB", 12)):
        one = 10**power
        tenths, whole = F.expr("0").cast("long") + F.floor((b + one // 20) / F.lit(one // 10)), F.floor((b + one // 2) / F.lit(one))
        text = F.when(b < 10 * one, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))).otherwise(whole.cast("string"))
        text = F.concat(text, F.lit(f" {unit}"))
        out = out.when(b < one * 1000, text) if unit != "TB" else out.otherwise(text)
    return out


def format_duration(ms: Column | str) -> Column:
    seconds = F.floor((col(ms) + 500) / 1000)
    return F.when(col(ms).isNull(), DASH).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")))


def projected_percent(total: Column | str, used: Column | str, incoming: Column | str) -> Column:
    t = col(total)
    return F.when(t <= 0, F.lit(100).cast("long")).otherwise(F.floor((col(used) + col(incoming)) * 100 / F.nullif(t, F.lit(0))))


def guard_exceeded(total: Column | str, used: Column | str, incoming: Column | str, threshold: int = 90) -> Column:
    return projected_percent(total, used, incoming) >= threshold


def disk_usage_percent(total: Column | str, used: Column | str) -> Column:
    """In tenths of a percent, cut off."""
    return F.when(col(total) <= 0, F.lit(0.0)).otherwise(F.floor(col(used) * 1000 / F.nullif(col(total), F.lit(0))) / 10.0)


def storage_severity(percent: Column | str) -> Column:
    p = col(percent)
    return F.when(p >= 90, "error").when(p >= 80, "warning").otherwise("none")


def storage_key(uuid: Column | str) -> Column:
    return F.replace(col(uuid), F.lit("-"), F.lit(""))


def valid_name(name: Column | str) -> Column:
    return col(name) != ""


def thumbnail_seek_ms(duration_ms: Column | str) -> Column:
    return F.floor(col(duration_ms) / 10)


def fit_box(width: Column | str, height: Column | str, box: int = 256) -> Column:
    """width, height shrunk to fit a square box; never enlarged, never below one."""
    w, h = col(width), col(height)
    longest = F.greatest(w, h)
    shrink = lambda x: F.when(longest <= box, x).otherwise(F.greatest(F.lit(1), F.floor((x * box * 2 + longest) / (longest * 2))))
    return F.struct(shrink(w).cast("int").alias("width"), shrink(h).cast("int").alias("height"))
