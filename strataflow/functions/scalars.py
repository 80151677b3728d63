"""Scalar rules as Column expressions: names, versions, rectangles, sizes, quantisers.

Rectangles are structs (left, top, right, bottom) of doubles in 0..1, y down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SIZE = 0.02
MAX_REGION = 800_000
MARGINS = (28, 14, 8)
# Source factor and bits per pixel of each quality, and the limits of a target bitrate.
QUALITIES = {"STANDARD": (1.0, 0.10), "HIGH": (1.5, 0.16), "MAXIMUM": (2.0, 0.30)}
MIN_BITRATE, MAX_BITRATE = 2_000_000, 120_000_000
#: Names from content providers may hold any Unicode white space.
_BLANK = "(?U)^\\s+|\\s+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def safe_name(name: Column) -> Column:
    """A file name without extension, separators, control characters or '..'; never blank."""
    base = F.regexp_replace(name, "\\.[^.]*$", "")
    base = F.replace(F.regexp_replace(base, '[\\\\/:*?"<>|\\x00-\\x1F]', ""), F.lit(".."), F.lit(""))
    base = _trim(F.substring(F.regexp_replace(_trim(base), "^\\.+", ""), 1, 96))
    return F.when(base == "", "video").otherwise(base)


# Fixed value: what a processed file's name ends with.
SUFFIX = "_sans_filigrane.mp4"


def display_name(name: Column, suffix: str = SUFFIX) -> Column:
    return F.concat(safe_name(name), F.lit(suffix))


def safe_version(version: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(version, "^v", ""), "[^0-9.]", ""), "\\.+", ".")
    v = F.regexp_replace(F.substring(F.regexp_replace(v, "^\\.+|\\.+$", ""), 1, 32), "^\\.+|\\.+$", "")
    return F.when(v == "", "update").otherwise(v)


def version_parts(version: Column) -> Column:
    core = F.substring_index(F.regexp_replace(version, "^v", ""), "-", 1)
    return F.transform(F.split(core, "\\."), lambda x: F.coalesce(F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("int")), F.lit(0)))


def is_newer(candidate: Column, current: Column) -> Column:
    """Strictly newer, compared part by part with missing parts as 0."""
    signs = F.zip_with(version_parts(candidate), version_parts(current), lambda a, b: F.signum(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))))
    return F.coalesce(F.get(F.filter(signs, lambda s: s != 0), F.lit(0)) > 0, F.lit(False))


def duration_text(ms: Column) -> Column:
    """mm:ss with unbounded minutes; negative durations count as 0."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return F.concat(F.format_string("%02d", F.floor(s / 60)), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


# Labels of the methods.
LABELS = {"INPAINT": "Reconstruction", "BLUR": "Blur", "PIXELATE": "Pixelate", "CROP": "Crop"}


def method_label(method: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[method]


def size_text(size: Column) -> Column:
    """A size in units of 1000 with about two digits, a unit up from 900 on."""
    value, unit = size.cast("double"), F.lit("B")
    for step, name in enumerate(("kB", "MB", "GB", "TB", "PB"), 1):
        unit = F.when(size.cast("double") > 900 * 1000.0 ** (step - 1), name).otherwise(unit)
        value = F.when(size.cast("double") > 900 * 1000.0 ** (step - 1), size / 1000.0**step).otherwise(value)
    digits = F.when((unit == "B") | (value >= 10), F.format_string("%.0f", value)).when(value < 1, F.format_string("%.2f", value)).otherwise(F.format_string("%.1f", value))
    return F.concat_ws(" ", digits, unit)


def relative_date(millis: Column, now: Column) -> Column:
    """Empty without a date; minutes, hours and days ago within a week, then the day (UTC)."""
    minutes = F.floor((now - millis) / 60_000)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86_400_000).cast("int")), "yyyy-MM-dd")
    text = F.when(minutes < 60, ago(F.greatest(minutes, F.lit(0)), "minute")).when(minutes < 1440, ago(F.floor(minutes / 60), "hour")).when(minutes < 10_080, ago(F.floor(minutes / 1440), "day"))
    return F.when(F.coalesce(millis, F.lit(0)) <= 0, "").otherwise(F.coalesce(text, day))


def bitrate_label(bits: Column) -> Column:
    return F.format_string("%.0f Mb/s", bits / 1_000_000.0)


def name_and_size(name: Column, size: Column) -> Column:
    """What a content provider tells, with its defaults."""
    return F.struct(F.coalesce(name, F.lit("video.mp4")).alias("name"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))


def trusted_url(url: Column, host: str = "github.com") -> Column:
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & (F.lower(F.try_parse_url(url, F.lit("HOST"))) == host), F.lit(False))


def digest_token(text: Column) -> Column:
    """First token of a digest file, lower-cased; null unless it has 64 hex digits."""
    token = F.lower(F.get(F.split(_trim(text), "\\s+"), F.lit(0)))
    return F.when(token.rlike("^[0-9a-f]{64}$"), token)


def archive_ok(content: Column, expected: Column, least: int = 65_536) -> Column:
    """Integrity gate of a package: size, ZIP magic, and the digest where one is given."""
    return (F.octet_length(content) >= least) & (F.substring(content, 1, 2) == F.unhex(F.lit("504B"))) & (expected.isNull() | (F.sha2(content, 256) == expected))


def clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi < lo, lo).otherwise(F.greatest(lo, F.least(hi, v)))


def rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def _unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def rect_sanitized(r: Column) -> Column:
    le, t = _unit(F.least(r.left, r.right)), _unit(F.least(r.top, r.bottom))
    ri, b = _unit(F.greatest(r.left, r.right)), _unit(F.greatest(r.top, r.bottom))
    grow = lambda lo, hi: F.when(hi - lo < MIN_SIZE, F.least(F.lit(1.0), lo + MIN_SIZE)).otherwise(hi)
    return rect(le, t, grow(le, ri), grow(t, b))


def rect_from_center(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return rect_sanitized(rect(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2))


def rect_translated(r: Column, dx: Column, dy: Column) -> Column:
    x, y = clamp(dx, -r.left, 1 - r.right), clamp(dy, -r.top, 1 - r.bottom)
    return rect(r.left + x, r.top + y, r.right + x, r.bottom + y)


def rect_resized(r: Column, corner: Column, dx: Column, dy: Column) -> Column:
    """Drags TOP_LEFT, TOP_RIGHT, BOTTOM_LEFT or BOTTOM_RIGHT; sides keep MIN_SIZE apart."""
    zero, one = F.lit(0.0), F.lit(1.0)
    left = F.when(corner.endswith("LEFT"), clamp(r.left + dx, zero, r.right - MIN_SIZE)).otherwise(r.left)
    right = F.when(corner.endswith("RIGHT"), clamp(r.right + dx, r.left + MIN_SIZE, one)).otherwise(r.right)
    top = F.when(corner.startswith("TOP"), clamp(r.top + dy, zero, r.bottom - MIN_SIZE)).otherwise(r.top)
    bottom = F.when(corner.startswith("BOTTOM"), clamp(r.bottom + dy, r.top + MIN_SIZE, one)).otherwise(r.bottom)
    return rect(left, top, right, bottom)


def rect_contains(r: Column, x: Column, y: Column) -> Column:
    return x.between(r.left, r.right) & y.between(r.top, r.bottom)


def crop_excluding(zone: Column) -> Column:
    """Largest of the rectangles above, below, left and right of a sanitised zone; ties go to the first."""
    zero, one = F.lit(0.0), F.lit(1.0)
    areas = F.array(zone.top, one - zone.bottom, zone.left, one - zone.right)
    best = F.array_position(areas, F.array_max(areas))
    return F.when(best == 1, rect(zero, zero, one, zone.top)).when(best == 2, rect(zero, zone.bottom, one, one)).when(best == 3, rect(zero, zero, zone.left, one)).otherwise(rect(zone.right, zero, one, one))


def to_ndc(r: Column) -> Column:
    """Edges in -1..1 with y up."""
    return rect(r.left * 2 - 1, 1 - r.top * 2, r.right * 2 - 1, 1 - r.bottom * 2)


def even_size(side: Column, share: Column) -> Column:
    n = F.greatest(F.floor(side * share).cast("int"), F.lit(2))
    return n - n % 2


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


def region_of(r: Column, width: Column, height: Column) -> Column:
    """(left, top, width, height) in pixels with the widest margin that keeps to MAX_REGION pixels."""

    def at(margin: int) -> Column:
        le = F.greatest(half_up(r.left * width) - margin, F.lit(0))
        t = F.greatest(half_up(r.top * height) - margin, F.lit(0))
        ri = F.least(half_up(r.right * width) + margin, width)
        b = F.least(half_up(r.bottom * height) + margin, height)
        return F.struct(le.alias("left"), t.alias("top"), F.greatest(ri - le, F.lit(1)).alias("width"), F.greatest(b - t, F.lit(1)).alias("height"))

    fits = lambda s: s.width.cast("long") * s.height <= MAX_REGION
    wide, middle = at(MARGINS[0]), at(MARGINS[1])
    return F.when(fits(wide), wide).when(fits(middle), middle).otherwise(at(MARGINS[2]))


def target_bitrate(width: Column, height: Column, fps: Column, source: Column, quality: str = "MAXIMUM") -> Column:
    factor, per_pixel = QUALITIES[quality]
    rate = F.when(fps > 1, fps).otherwise(30.0)
    least = F.floor(width.cast("long") * height * per_pixel * rate)
    return F.greatest(F.lit(MIN_BITRATE), F.least(F.lit(MAX_BITRATE), F.greatest(least, F.floor(source * factor)))).cast("int")


def bitrate_or_derived(bitrate: Column, size: Column, duration_ms: Column) -> Column:
    return F.when(bitrate > 0, bitrate.cast("long")).when(duration_ms > 0, F.least(F.floor(size.cast("long") * 8000 / duration_ms), F.lit(2147483647))).otherwise(F.lit(0))


def display_size(width: Column, height: Column, rotation: Column) -> Column:
    turned = F.pmod(rotation, F.lit(360)) % 180 != 0
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def container_info(width: Column, height: Column, rotation: Column, duration_ms: Column, size: Column, bitrate: Column, frame_rate: Column) -> Column:
    """Metadata texts of a container with their defaults; null without a video track."""
    number = lambda c, kind: F.coalesce(F.when(c.rlike("^[+-]?[0-9]+$"), c.try_cast(kind)), F.lit(0))
    w, h, ms, rate = number(width, "int"), number(height, "int"), number(duration_ms, "long"), number(bitrate, "int")
    known = F.when((rate > 0) | (size <= 0) | (ms <= 0), rate.cast("long")).otherwise(bitrate_or_derived(rate, size, ms))
    fields = {"width": w, "height": h, "rotation": F.pmod(number(rotation, "int"), F.lit(360)), "duration_ms": ms, "bitrate": known, "frame_rate": F.coalesce(frame_rate.try_cast("float"), F.lit(0.0))}
    return F.when((w > 0) & (h > 0), F.struct(*(c.alias(k) for k, c in fields.items())))


def bounded_size(width: Column, height: Column, most: int, least: int = 1) -> Column:
    """Size scaled down to a largest side of ``most``, rounded down; as it is where it is small enough."""
    largest = F.greatest(width, height)
    side = lambda n: F.when(largest <= most, n).otherwise(F.greatest(F.floor(n.cast("long") * most / largest), F.lit(least))).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def thumbnail(width: Column, height: Column, duration_ms: Column) -> Column:
    """Where a thumbnail is taken (a quarter of the way, in microseconds) and its size (512 at most)."""
    return F.struct(F.floor(duration_ms.cast("long") * 1000 / 4).alias("time_us"), bounded_size(width, height, 512, 0).alias("size"))


def texture_scale(width: Column, height: Column, y_up: Column) -> Column:
    return F.struct(width.cast("double").alias("x"), F.when(y_up, -height).otherwise(height).cast("double").alias("y"))


def byte_clamp(v: Column) -> Column:
    return F.least(v, F.lit(255)).cast("int")


def uses_shader(method: Column) -> Column:
    """Whether a method is drawn by the spatial kernels: all but CROP, whose number is negative."""
    return F.coalesce(F.when(method == "BLUR", 1).when(method == "PIXELATE", 2).when(method == "INPAINT", 0).otherwise(-1) >= 0, F.lit(False))


def feather_units(inpaint: Column, feather: Column, width: Column, height: Column) -> Column:
    pixels = F.when(inpaint, F.lit(2.5)).otherwise(feather * 0.03 * F.least(width, height))
    return F.when((width <= 0) | (height <= 0), F.lit(0.0)).otherwise(pixels / F.greatest(width, height))


def method_id(method: Column, usable_layer: Column) -> Column:
    """CROP and INPAINT 0, BLUR 1, PIXELATE 2; INPAINT with a usable layer 3."""
    return F.when((method == "INPAINT") & usable_layer, 3).when(method == "BLUR", 1).when(method == "PIXELATE", 2).otherwise(0)


def sample_count(duration_ms: Column) -> Column:
    return F.when(duration_ms <= 0, 16).when(duration_ms < 4000, 10).when(duration_ms < 15000, 16).when(duration_ms < 60000, 20).otherwise(24)


def encode_weight(w: Column) -> Column:
    return F.when(w <= 1, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(255), F.floor(32 * F.log10(w) + 0.5)))).cast("int")


def decode_weight(b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.pow(F.lit(10.0), b / 32.0))


def parabolic_offset(e0: Column, e1: Column, e2: Column) -> Column:
    d = e0 - 2 * e1 + e2
    return F.when(F.abs(d) < 1e-9, 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (e0 - e2) / d)))


def quantise(v: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("int")


def caption(width: Column, height: Column, *parts: Column) -> Column:
    """Parts that aren't blank and the size where it is known, joined by a bullet."""
    size = F.when(width > 0, F.concat(width.cast("string"), F.lit("×"), height.cast("string")))
    return F.concat_ws(" • ", *(F.nullif(p, F.lit("")) for p in parts), size)


def rect_distance(x: Column, y: Column, r: Column) -> Column:
    """Signed distance to a rectangle, negative inside."""
    dx, dy = F.greatest(r.left - x, x - r.right), F.greatest(r.top - y, y - r.bottom)
    outside = F.sqrt(F.pow(F.greatest(dx, F.lit(0.0)), 2) + F.pow(F.greatest(dy, F.lit(0.0)), 2))
    return outside + F.least(F.greatest(dx, dy), F.lit(0.0))


def feather_mix(distance: Column, feather: float) -> Column:
    """1 inside, falling smoothly to 0 at the feather's width."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance / feather))
    return 1 - t * t * (3 - 2 * t)
