"""Scalar helpers as Column expressions: strings, paths, dates, numbers, packed versions, log and metric classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# They must equal what clients of the log use.
EMAIL = r"^[\w\-+.]+@([\w\-]+\.)+[\w\-]{2,4}$"
LTR = r"A-Za-zÀ-ÖØ-öø-ʸ̀-֐ࠀ-῿Ⰰ-﬜﷾-﹯﻽-￿"
RTL = r"֑-߿יִ-﷽ﹰ-ﻼ"
SEVERITY = {"EMERGENCY": 800, "ALERT": 700, "CRITICAL": 600, "ERROR": 500, "WARNING": 400, "NOTICE": 300, "METRIC": 250, "EVENT": 225, "INFO": 200, "DEBUG": 100, "DEFAULT": 0}
SERVER_METRICS = ["PeerResponseTime", "CommitsPersistTime", "CommitsPersistCount", "DeltaFormatSavings", "ServerStarted", "HttpStatusCode", "IncompatibleProtocolVersion", "InternalServerError", "EmailSent", "OperatorLogsQuery", "DBError"]
CLIENT_METRICS = ["QueryFired", "QueryCancelled", "QueryCompleted", "FullTextIndexingTime"]
MAX_TIMESTAMP = 9_007_199_254_740_991


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# strings and paths


def splice(s: str | Column, start: int, length: int, insert: str = "") -> Column:
    """``length`` characters from ``start`` (from 0) give way to ``insert``."""
    return F.concat(F.substring(col(s), 1, start), F.lit(insert), F.substring(col(s), start + length + 1, 1 << 30))


def common_prefix_length(a: str | Column, b: str | Column) -> Column:
    a, b = col(a), col(b)
    n = F.least(F.length(a), F.length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc))


def common_suffix_length(a: str | Column, b: str | Column) -> Column:
    return common_prefix_length(F.reverse(col(a)), F.reverse(col(b)))


def successor(s: str | Column) -> Column:
    """The least string after all that start with ``s``, by code point: its last character plus one."""
    last = F.ascii(F.substring(col(s), -1, 1))
    return F.when(col(s) == "", F.lit("\x00")).otherwise(F.concat(F.substring(col(s), F.lit(1), F.length(col(s)) - 1), F.decode(F.unhex(F.lpad(F.hex(last + 1), 8, "0")), "UTF-32")))


def append_path(path: str | Column, *parts: str | Column) -> Column:
    """Components joined by one slash; null and empty ones are left out, and a slash already there isn't doubled."""
    out = col(path)
    for p in map(col, parts):
        joined = F.when(out.endswith("/") | p.startswith("/"), F.concat(out, p)).otherwise(F.concat(out, F.lit("/"), p))
        out = F.when(p.isNull() | (p == ""), out).otherwise(joined)
    return out


def parse_path(path: str | Column) -> Column:
    """``/type/repo/item[/embed]`` as a struct."""
    part = F.split(F.trim(col(path), F.lit("/")), "/")
    return F.struct(*[F.nullif(F.get(part, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("type", "repo", "item", "embed"))])


def normalize_repo_id(path: str | Column) -> Column:
    return F.concat(F.lit("/"), F.trim(col(path), F.lit("/")))


def without_shard(repo: str | Column) -> Column:
    return F.split_part(col(repo), F.lit("--"), F.lit(1))


def is_rtl(s: str | Column) -> Column:
    return col(s).rlike(f"^[^{LTR}]*[{RTL}]")


def is_ltr(s: str | Column) -> Column:
    return ~col(s).rlike(r"[\W0-9]")


def writing_direction(s: str | Column, base: str = "auto") -> Column:
    """The direction of the first character that has one."""
    strong = F.regexp_extract(col(s), f"([{RTL}]|[A-Za-z_])", 1)
    return F.when(col(s).isNull() | (strong == ""), base).when(strong.rlike(f"[{RTL}]"), "rtl").otherwise("ltr")


def normalize_email(s: str | Column) -> Column:
    low = F.lower(F.trim(col(s)))
    return F.when(low.rlike(EMAIL), low)


def match_ends(s: str | Column, pattern: str) -> Column:
    """Ends (from 0, exclusive) of all matches, left to right."""
    pieces = F.split(col(s), pattern, -1)
    found = F.regexp_extract_all(col(s), F.lit(f"({pattern})"), F.lit(1))
    steps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda a, b: F.length(a) + F.length(b))
    zero = F.array().cast("array<int>")
    return F.aggregate(steps, zero, lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))


def compare(a: str | Column, b: str | Column) -> Column:
    return F.when(col(a) < col(b), -1).when(col(a) > col(b), 1).otherwise(0)


def org_from_url(url: str | Column) -> Column:
    """First of exactly three host components; localhost by its names; else null."""
    host = F.lower(F.try_parse_url(col(url), F.lit("HOST")))
    part = F.split(host, r"\.")
    first = F.get(part, F.lit(0))
    return F.when(host.isin("localhost", "127.0.0.1"), "localhost").when((F.size(part) == 3) & first.rlike("^[a-z0-9][a-z0-9-]*$"), first)


# dates


def decode_date(x: str | Column) -> Column:
    """Numbers under 1e12 are seconds, others milliseconds."""
    n = col(x).cast("double")
    return F.timestamp_millis(F.round(F.when(n < 1e12, n * 1000).otherwise(n)).cast("bigint"))


def encode_date(ts: str | Column) -> Column:
    return F.unix_millis(col(ts).cast("timestamp")) / F.lit(1000.0)


def start_of_day(d: str | Column) -> Column:
    return F.date_trunc("day", col(d)).cast("timestamp_ntz")


def start_of_month(d: str | Column) -> Column:
    return F.date_trunc("month", col(d)).cast("timestamp_ntz")


def start_of_week(d: str | Column) -> Column:
    """Weeks start on Sunday."""
    return F.date_sub(col(d).cast("date"), F.dayofweek(col(d)) - 1)


def days_in_month(d: str | Column) -> Column:
    return F.day(F.last_day(col(d)))


def days_left_in_month(d: str | Column) -> Column:
    """With the day itself."""
    return days_in_month(d) - (F.day(col(d)) - 1)


def workdays_left_in_week(d: str | Column) -> Column:
    return F.greatest(F.lit(0), F.lit(5) - (F.dayofweek(col(d)) - 1))


def relative_label(d: str | Column, today: Column) -> Column:
    gap = F.datediff(today, col(d))
    return F.when(gap == 0, "Today").when(gap == 1, "Yesterday").otherwise(F.date_format(col(d), "MMM d, yyyy"))


def reverse_timestamp(x: str | Column) -> Column:
    return F.lit(MAX_TIMESTAMP) - col(x)


# units of time in milliseconds

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000


def in_milliseconds(x: str | Column, unit: int) -> Column:
    return (col(x) * unit).cast("double")


# base 32 in lower case for addresses, the padding's first sign as an underscore

_DIGITS, _LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567"


def encode_base32(value: str | Column) -> Column:
    """Five bytes are eight digits: blocks of ten hexadecimal digits go through base 32."""
    raw = F.hex(col(value).cast("binary"))
    n = F.length(raw) / 2
    blocks = F.ceil(n / 5).cast("int")
    padded = F.rpad(raw, blocks * 10, "0")
    at = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    digits = F.array_join(F.transform(at, lambda i: F.lpad(F.conv(F.substring(padded, i * 10 + 1, F.lit(10)), 16, 32), 8, "0")), "")
    kept = F.translate(F.substring(digits, F.lit(1), F.ceil(n * 8 / 5).cast("int")), _DIGITS, _LETTERS)
    return F.regexp_replace(F.rpad(kept, blocks * 8, "="), "^([^=]*)=", "$1_")


def decode_base32(value: str | Column) -> Column:
    """The bytes of ``encode_base32``."""
    bare = F.regexp_replace(F.lower(col(value)), "[_=]", "")
    n = F.floor(F.length(bare) * 5 / 8).cast("int")
    blocks = F.ceil(F.length(bare) / 8).cast("int")
    padded = F.rpad(F.translate(bare, _LETTERS, _DIGITS), blocks * 8, "0")
    at = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    digits = F.array_join(F.transform(at, lambda i: F.lpad(F.conv(F.substring(padded, i * 8 + 1, F.lit(8)), 32, 16), 10, "0")), "")
    return F.unhex(F.substring(digits, F.lit(1), n * 2))


# numbers


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """A whole number from ``low`` up to, and without, ``high``."""
    return (F.floor(F.rand(seed) * (high - low)) + low).cast("bigint")


def clip(x: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def ease(x: str | Column, kind: str) -> Column:
    """Quadratic-in, sine in-out, quintic in-out and exponential in-out curves on [0, 1]."""
    t = clip(x)
    curves = {
        "quad": F.pow(t, 2),
        "sine": (F.lit(1) - F.cos(F.lit(3.141592653589793) * t)) / 2,
        "quint": F.when(t < 0.5, 16 * F.pow(t, 5)).otherwise(1 - F.pow(2 - 2 * t, 5) / 2),
        "expo": F.when(t == 0, 0.0).otherwise(F.pow(F.lit(2.0), 10 * t - 10)),
    }
    return curves[kind]


def numbers_equal(a: str | Column, b: str | Column) -> Column:
    return ~F.isnan(col(a)) & ~F.isnan(col(b)) & (F.abs(col(a) - col(b)) < 2.0**-52)


def average(x: str | Column) -> Column:
    return F.coalesce(F.avg(col(x)), F.lit(0.0))


# packed versions: four bytes, the first part highest


def pack_version(*parts: str | Column) -> Column:
    shifted = [F.shiftleft(col(p).cast("int").bitwiseAND(255), 24 - 8 * i) for i, p in enumerate(parts)]
    out = shifted[0]
    for s in shifted[1:]:
        out = out.bitwiseOR(s)
    return out


def version_part(v: str | Column, at: int) -> Column:
    """Part ``at`` from the lowest byte."""
    return F.shiftright(col(v), 8 * at).bitwiseAND(255)


def format_version(v: str | Column) -> Column:
    last = version_part(v, 0)
    return F.concat(F.concat_ws(".", *[version_part(v, i).cast("string") for i in (3, 2, 1)]), F.when(last != 0, F.concat(F.lit("-"), last.cast("string"))).otherwise(""))


# logs and metrics


def severity_code(name: str | Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[col(name)], F.lit(0))


def severity_name(code: str | Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (v, k)])[col(code)], F.lit("DEFAULT"))


def metric_side(name: str | Column) -> Column:
    return F.when(col(name).isin(CLIENT_METRICS), "client").when(col(name).isin(SERVER_METRICS), "server")


def is_metric(severity: str | Column, name: str | Column) -> Column:
    return col(severity).isin("METRIC", "ERROR") & F.coalesce(metric_side(name).isNotNull(), F.lit(False))


def has_url(url: str | Column, urls: str | Column) -> Column:
    return col(url).isNotNull() | F.coalesce(F.size(col(urls)) > 0, F.lit(False))
