"""Formatting and small codecs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a mile and a foot, words that stay small in names.
MILE, FOOT = 1609.344, 0.3048
SMALL_WORDS = ("and", "of", "the")


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def whole(c: Column) -> Column:
    return half_up(c).cast("long").cast("string")


def fixed(c: Column, digits: int) -> Column:
    """Digits after the point, rounded by the number's exact value; exact ties (only binary fractions can be) go up."""
    tie = F.pmod(c * F.lit(2.0 ** (digits + 1)), F.lit(2.0)) == 1.0
    return F.replace(F.format_number(F.when(tie, c + F.lit(10.0 ** -(digits + 3))).otherwise(c), digits), F.lit(","), F.lit(""))


def distance(m: Column, units: str = "metric") -> Column:
    if units == "imperial":
        mi = m / F.lit(MILE)
        feet = F.concat((half_up(m / F.lit(FOOT) / F.lit(10.0)) * 10).cast("long").cast("string"), F.lit(" ft"))
        return F.when(mi < 0.19, feet).otherwise(F.concat(F.when(mi < 10, fixed(mi, 1)).otherwise(whole(mi)), F.lit(" mi")))
    km = m / F.lit(1000.0)
    near = F.concat((half_up(m / F.lit(10.0)) * 10).cast("long").cast("string"), F.lit(" m"))
    return F.when(m < 950, near).otherwise(F.concat(F.when(km < 10, fixed(km, 1)).otherwise(whole(km)), F.lit(" km")))


def distance_tidy(m: Column, units: str = "metric") -> Column:
    return F.regexp_replace(distance(m, units), r"\.0(?=\s)", "")


def area(m2: Column, units: str = "metric") -> Column:
    a = m2 / F.lit(MILE * MILE if units == "imperial" else 1e6)
    return F.concat(F.when(a < 1, fixed(a, 2)).when(a < 10, fixed(a, 1)).otherwise(whole(a)), F.lit(" mi²" if units == "imperial" else " km²"))


def minutes(m: Column) -> Column:
    n = half_up(m).cast("long")
    h, r = F.floor(n / 60).cast("string"), n % 60
    return F.when(n < 60, F.concat(n.cast("string"), F.lit(" min"))).when(r == 0, F.concat(h, F.lit(" h"))).otherwise(F.concat(h, F.lit(" h "), F.lpad(r.cast("string"), 2, "0"), F.lit(" min")))


def elapsed(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), F.lpad((s % 60).cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), F.lpad(m.cast("string"), 2, "0"), r)).otherwise(F.concat_ws(":", m.cast("string"), r))


def bytes_text(b: Column) -> Column:
    kb, mb = b / F.lit(1024.0), b / F.lit(1024.0 * 1024)
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1024 * 1024, F.concat(whole(kb), F.lit(" KB"))).otherwise(F.concat(F.when(b < 10 * 1024 * 1024, fixed(mb, 1)).otherwise(whole(mb)), F.lit(" MB")))


def percent(p: Column) -> Column:
    return F.concat(whole(p), F.lit("%"))


def relative_day(ms: Column, now: Column) -> Column:
    days = F.floor((now - ms) / 86_400_000).cast("long")
    months = F.floor(days / 30).cast("long")
    text = F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 30, F.concat(days.cast("string"), F.lit(" days ago")))
    text = text.when(months < 12, F.concat(months.cast("string"), F.when(months == 1, " month ago").otherwise(" months ago"))).otherwise(F.date_format(F.timestamp_millis(ms.cast("long")), "MMM d, yyyy"))
    return F.when(ms.isNull() | (ms == 0), "never").otherwise(text)


def age(ms: Column) -> Column:
    m = half_up(ms / 60_000).cast("long")
    h = half_up(m / 60).cast("long")
    return F.when(m < 1, "just now").when(m < 60, F.concat(m.cast("string"), F.lit(" min ago"))).when(h < 48, F.concat(h.cast("string"), F.lit(" h ago"))).otherwise(F.concat(whole(h / 24), F.lit(" days ago")))


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))


def region_name(region: Column) -> Column:
    """'canada/british-columbia' -> 'British Columbia'."""
    last = F.element_at(F.split(region, "/"), -1)
    words = F.transform(F.split(last, "-"), lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(capital(w)))
    return F.array_join(words, " ")


def region_country(region: Column) -> Column:
    parts = F.split(region, "/")
    country = F.element_at(parts, -2)
    tag = F.when(F.length(country) <= 3, F.upper(country)).otherwise(capital(country))
    return F.when(F.size(parts) >= 2, tag).otherwise("")


def source_regions(source: Column) -> Column:
    """Region ids of a provenance line, each once, in order: 'Geofabrik us/delaware, ontario (+ border merge)'."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), r"(?i)^\s*geofabrik\s+", ""), r"\s*\(\+[^)]*\)\s*$", "")
    ids = F.transform(F.split(body, ","), lambda p: F.element_at(F.split(F.trim(p), r"\s+"), 1))
    return F.array_distinct(F.filter(ids, lambda x: x.rlike(r"^[a-z][a-z-]*(/[a-z][a-z-]*)*$")))


def slug(label: Column, most: int = 40) -> Column:
    """Lower-case ASCII words joined by hyphens; accents fall off letters, so a table of letters does for decomposition."""
    plain = F.translate(label, "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ", "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy")
    s = F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, most), r"-+$", "")
    return F.when(s == "", "route").otherwise(s)


def lat_lng(lon: Column, lat: Column) -> Column:
    f = lambda v: F.regexp_replace(fixed(v, 5), r"^-0\.00000$", "0.00000")
    return F.concat_ws(",", f(lat), f(lon))


def directions_url(start: Column, end: Column, corners: Column, navigate: bool = False) -> Column:
    way = F.when(F.size(corners) > 0, F.concat(F.lit("&waypoints="), F.array_join(corners, "%7C"))).otherwise("")
    return F.concat(F.lit("https://www.google.com/maps/dir/?api=1&origin="), start, F.lit("&destination="), end, way, F.lit("&travelmode=walking" + "&dir_action=navigate" * navigate))


def apple_url(end: Column, start: Column | None = None) -> Column:
    return F.concat(F.lit("https://maps.apple.com/?"), F.concat(F.lit("saddr="), start, F.lit("&")) if start is not None else F.lit(""), F.lit("daddr="), end, F.lit("&dirflg=w"))


def receiver_url(raw: Column) -> Column:
    """https (http only for this machine), no query, fragment or slash at the end; null if it cannot be one."""
    s = F.trim(raw)
    full = F.when(s.rlike(r"(?i)^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    bare = F.regexp_replace(F.regexp_replace(full, r"[?#].*$", ""), r"/+$", "")
    local = bare.rlike(r"(?i)^http://(localhost|127\.0\.0\.1)([:/]|$)")
    return F.when(s == "", "").when(bare.rlike(r"(?i)^https://[^/\s]+") | local, bare)


def valid_token(t: Column) -> Column:
    return F.trim(t).rlike(r"^[A-Za-z0-9_-]{8,128}$")


def mask_token(t: Column) -> Column:
    s = F.trim(t)
    return F.when(F.length(s) <= 8, "••••").otherwise(F.concat(F.substring(s, 1, 4), F.lit("…"), F.substring(s, -4, 4)))


def batch_suffix(ms: Column, n: Column) -> Column:
    return F.concat_ws("-", F.lpad(F.greatest(F.lit(0), F.floor(ms)).cast("long").cast("string"), 13, "0"), F.lpad((n % 100_000).cast("string"), 5, "0"))


def key_epoch(key: Column) -> Column:
    pattern = r"(?:^|/)(\d{13})-\d{5}$"
    return F.when(key.rlike(pattern), F.regexp_extract(key, pattern, 1).cast("long"))


def cursor_suffix(since: Column, prefix: Column) -> Column:
    return F.when(F.startswith(since, prefix), F.substr(since, F.length(prefix) + 1)).otherwise(since)


def fnv1a(text: Column) -> Column:
    """32-bit hash over code points (equal to UTF-16 units below U+10000)."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), step)


def heat_intensity(count: Column) -> Column:
    return F.when(count > 0, F.lit(0.22) + F.lit(0.78) * F.least(F.lit(1.0), (count - 1) / F.lit(7.0))).otherwise(F.lit(0.0))


def smoothstep(a: float, b: float, t: Column) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - F.lit(a)) / F.lit(b - a)))
    return u * u * (F.lit(3.0) - F.lit(2.0) * u)


def retry_delay(failures: Column, retry_after_ms: Column) -> Column:
    """A minute doubling up to an hour; what the server asks for wins."""
    return F.coalesce(retry_after_ms.cast("double"), F.least(F.lit(60_000.0) * F.pow(F.lit(2.0), failures - 1), F.lit(3_600_000.0)))
