"""Scalar functions on strings, times and scores, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("emotional", "cognitive", "social", "communication", "contextual", "artistic")
#: Path segments that name no topic.
STOP_SEGMENTS = ("www", "index", "html", "htm", "php", "amp", "en", "en-us", "us", "news", "article", "articles", "story", "stories", "page", "pages", "p", "id")
#: The alphabet of pseudonyms.
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def slug(c: Column | str, most: int = 80) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, no dash at the ends."""
    return F.substring(F.trim(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def multi_values(c: Column | str, most: int = 12) -> Column:
    """The non-empty parts between ``| , ;``, trimmed, at most ``most``."""
    parts = F.transform(F.split(col(c), "[|,;]"), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: x != ""), 1, most)


def host_of(url: Column | str) -> Column:
    """Lower-case host, with its port, and without scheme and ``www.``; empty if there is none.
    A URL may come without a scheme."""
    return F.regexp_replace(F.lower(F.regexp_extract(col(url), r"(?i)^(?:https?://)?([^/?#\s]+)", 1)), r"^www\.", "")


def path_topics(url: Column | str, most: int = 2) -> Column:
    """The first distinct path segments that tell a topic: three characters or more, not
    numbers, no stop words; of a page's file name without its extension and of dashed names
    the first four parts."""
    path = F.regexp_replace(F.regexp_replace(col(url), r"(?i)^https?://[^/]+", ""), r"[?#][\s\S]*$", "")
    parts = F.transform(F.split(path, "/"), lambda s: F.lower(F.trim(s)))
    told = F.filter(parts, lambda s: (F.length(s) >= 3) & ~s.rlike("^[0-9]+$") & ~s.isin(*STOP_SEGMENTS))
    short = F.transform(told, lambda s: F.array_join(F.slice(F.split(F.regexp_replace(s, r"\.(html?|php|aspx)$", ""), "-"), 1, 4), "-"))
    return F.slice(F.array_distinct(F.filter(short, lambda s: F.length(s) >= 3)), 1, most)


def daypart(ts: Column | str) -> Column:
    """Band of the UTC hour: overnight, morning, afternoon, primetime or latenight."""
    h = F.hour(col(ts))
    return F.when(h < 6, "overnight").when(h < 12, "morning").when(h < 17, "afternoon").when(h < 22, "primetime").when(h < 24, "latenight")


def daypart_of_text(text: Column | str) -> Column:
    """``daypart`` of an ISO time given as text; a zone, Z or an offset, is heeded, and without
    one the time is UTC. Empty for text that is no time."""
    return F.coalesce(daypart(F.try_to_timestamp(F.trim(col(text)))), F.lit(""))


def tag_signature(report_type: Column | str, codes: Column | str) -> Column:
    """Digest of the report type with the sorted distinct codes."""
    return F.sha2(F.concat_ws("|", col(report_type), F.array_join(F.array_sort(F.array_distinct(col(codes))), ",")).cast("binary"), 256)


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a of the text's UTF-16 code units, as a long."""
    units = F.hex(F.encode(col(c), "UTF-16BE"))
    at = F.when(F.length(col(c)) > 0, F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda i: F.conv(F.substring(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    return F.aggregate(at, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(unit(i)) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def is_holdout(name: Column | str, key: Column | str, share: float) -> Column:
    """True for about ``share`` of the keys of a cohort, always the same ones."""
    return fnv1a(F.concat_ws(":", col(name), col(key))) % 1000 < round(share * 1000)


def pseudonym(c: Column | str) -> Column:
    """``SIG-`` with six base-32 digits of the FNV-1a hash, the least digit last."""
    h = fnv1a(c)
    digit = lambda i: F.substring(F.lit(BASE32), F.shiftright(h, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.concat(F.lit("SIG-"), *[digit(i) for i in range(5, -1, -1)])


def is_aggregate_key(c: Column | str) -> Column:
    """Keys with a colon stand for groups."""
    return F.contains(col(c), F.lit(":"))


def export_id(c: Column | str) -> Column:
    """32 upper-case hex digits: of hex or a UUID the digits, of base64 of 16 bytes or more the
    first 16, else of the SHA-256; null for null, blank and aggregate keys."""
    raw = F.trim(col(c))
    hex32, uuid = raw.rlike("^[0-9A-Fa-f]{32}$"), raw.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    # Padding may be left out, but not be of a wrong length.
    plain = F.regexp_replace(raw, "=+$", "")
    fits = F.when(F.contains(raw, F.lit("=")), F.length(raw) % 4 == 0).otherwise(F.length(raw) % 4 != 1)
    coded = F.when(raw.rlike("^[A-Za-z0-9+/]{16,}={0,2}$") & fits, F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))
    decoded = F.hex(F.try_to_binary(coded, F.lit("base64")))
    hashed = F.upper(F.substring(F.sha2(raw.cast("binary"), 256), 1, 32))
    told = F.when(hex32, F.upper(raw)).when(uuid, F.upper(F.regexp_replace(raw, "-", ""))).when(F.length(decoded) >= 32, F.substring(decoded, 1, 32)).otherwise(hashed)
    return F.when(is_aggregate_key(raw) | (raw == ""), F.lit(None)).otherwise(told)


def logistic_percentile(x: Column | str, mean: Column, sd: Column) -> Column:
    """0 to 100 by a logistic curve of the z-score; 50 where the population has no spread."""
    z = (col(x) - mean) / sd
    return F.when(sd < 0.01, 50.0).otherwise(clamp(F.lit(100.0) / (1 + F.exp(-1.7 * z)), 0.0, 100.0))


def spread_confidence(axes: list[str]) -> Column:
    """Population deviation of a row's axes over 30, from 0.1 to 1."""
    values = F.array(*[F.col(a) for a in axes])
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / len(axes)
    var = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / len(axes)
    return clamp(F.sqrt(var) / 30, 0.1, 1.0)


def leading_axis(axes: list[str]) -> Column:
    """Name of the largest axis; the first of those that tie."""
    best = F.greatest(*[F.col(a) for a in axes])
    out = F.when(F.col(axes[0]) == best, axes[0])
    for a in axes[1:]:
        out = out.when(F.col(a) == best, a)
    return out


def intensity_confidence(n: Column | str, base: float) -> Column:
    """``min(1, 0.5 + log10(1 + n) / 4)`` for positive counts, else ``base``."""
    return F.when(col(n) > 0, F.least(F.lit(1.0), 0.5 + F.log10(1 + col(n)) / 4)).otherwise(F.lit(base))


def normal_cdf(z: Column | str) -> Column:
    """The standard normal distribution by the rational approximation of Abramowitz and Stegun
    7.1.26, to about seven digits."""
    x = F.abs(col(z)) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(col(z) >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def exact_mean(c: Column | str) -> Column:
    """The mean as an aggregate, whatever the order of the rows: numbers of up to six decimals and
    twelve digits before them are added as decimals. Where a group holds others, as doubles."""
    value = col(c).cast("double")
    told = value.try_cast("decimal(18,6)")
    plain = F.count_if(~F.equal_null(told.cast("double"), value)) == 0
    return F.when(plain, (F.sum(told) / F.count(told)).cast("double")).otherwise(F.avg(value))


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Round halves towards plus infinity."""
    return F.floor(col(c) * 10**digits + 0.5) / 10**digits


def is_device_id(c: Column | str) -> Column:
    """Shaped like a UUID, as advertising ids of devices are."""
    return col(c).rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def is_ipv4(c: Column | str) -> Column:
    return col(c).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def is_ipv6(c: Column | str) -> Column:
    return col(c).rlike("(?i)^[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,7}$")


def leaf_label(code: Column | str) -> Column:
    """The last dotted part of a code, dashes and underscores as blanks."""
    return F.translate(F.element_at(F.split(col(code), r"\."), -1), "-_", "  ")


def hours_between(later: Column | str, earlier: Column | str, digits: int = 1) -> Column:
    micros = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return F.round((micros(later) - micros(earlier)) / 3.6e9, digits)


def content_hash(*columns: Column | str) -> Column:
    """SHA-256 of the columns as JSON, in the given order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def time_bucket(first: Column | str, last: Column | str) -> Column:
    """``day``, ``week`` or ``month`` for a trend over a range: up to 45 days, 180, or more."""
    days = F.date_diff(col(last), col(first))
    return F.when(days <= 45, "day").when(days <= 180, "week").otherwise("month")


def pretty_tag(code: Column | str) -> Column:
    """A code for readers: an open age band as ``75+``, without the families of people and viewing,
    ``IAB`` before categories, dashes and underscores as blanks."""
    told = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(code), r"^demo\.age\.", ""), r"^demo\.", ""), r"^ctv\.(genre|channel)\.", "")
    told = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(told, r"^iab\.", "IAB "), "[-_]", " "), r"\s+", " "))
    age = F.regexp_extract(col(code), r"^demo\.age\.([0-9]+)$", 1)
    return F.when(age != "", F.concat(age, F.lit("+"))).otherwise(told)
