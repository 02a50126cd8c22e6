"""Per-row functions of the event-log model."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 0001-01-01, the origin windows are aligned to, to 1970-01-01.
ORIGIN_MICROS = 62_135_596_800_000_000
#: Alert severities and their weights; anything else weighs 0.
SEVERITIES = {"info": 1, "warning": 2, "error": 3, "critical": 4}


def micros(d: timedelta) -> int:
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def interval(d: timedelta) -> str:
    return f"{micros(d)} microseconds"


def origin_offset(d: timedelta) -> timedelta:
    """Start offset from the Unix epoch of windows of length d aligned to 0001-01-01 (a Monday)."""
    return timedelta(microseconds=-ORIGIN_MICROS % micros(d))


def split_words(text: Column) -> Column:
    """Words between spaces, tabs and line feeds (no other white space), case kept, no empty ones; null gives null."""
    return F.array_remove(F.split(F.translate(text, "\t\n", "  "), " "), "")  # one literal character: no regular expression, no lambda


def choose_partition(key: Column, partitions: Column | int) -> Column:
    """IEEE CRC-32 of the key's bytes modulo the number of partitions; null and empty keys go to 0."""
    n = F.lit(partitions) if isinstance(partitions, int) else partitions
    return F.when(key.isNull() | (F.length(key) == 0), F.lit(0)).otherwise(F.crc32(key) % n).cast("int")


def truncate_time(ts: Column, d: timedelta) -> Column:
    """The latest multiple of d since 0001-01-01 that is not after ts."""
    size = F.lit(micros(d))
    since = F.unix_micros(ts.cast("timestamp")) + F.lit(ORIGIN_MICROS)
    return F.timestamp_micros(since - F.pmod(since, size) - F.lit(ORIGIN_MICROS))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def state_key(key: Column, window_start: Column) -> Column:
    return F.concat_ws(":", key, rfc3339(window_start))


def sanitize_metric_name(name: Column) -> Column:
    return F.translate(name, "-. ", "___")


def sorted_pairs(labels: Column, fmt: str = "%s=%s") -> Column:
    """Label pairs as sorted strings."""
    return F.array_sort(F.transform(F.map_entries(labels), lambda e: F.format_string(fmt, e["key"], e["value"])))


def format_labels(labels: Column) -> Column:
    """`{k="v",...}` sorted, nothing for an empty or null map."""
    joined = F.array_join(sorted_pairs(labels, '%s="%s"'), ",")
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, F.lit("")).otherwise(F.concat(F.lit("{"), joined, F.lit("}")))


def add_label(labels_text: Column, key: str, value: Column) -> Column:
    """One more label at the end of a formatted label text."""
    pair = F.concat(F.lit(f'{key}="'), value, F.lit('"}'))
    return F.when(labels_text == "", F.concat(F.lit("{"), pair)).otherwise(F.concat(F.regexp_replace(labels_text, "\\}$", ","), pair))


def prometheus_type(kind: Column) -> Column:
    return F.when(kind.isin("counter", "gauge", "histogram"), kind).when(kind == "timer", F.lit("summary")).otherwise(F.lit("untyped"))


def merge_labels(first: Column, second: Column) -> Column:
    """Union of two label maps; the second wins."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(first), lambda e: ~F.map_contains_key(second, e["key"])), F.map_entries(second)))


def metric_key(name: Column, labels: Column) -> Column:
    return F.concat_ws(",", name, F.array_join(sorted_pairs(labels), ","))


def alert_id(rule: Column, labels: Column) -> Column:
    """`rule:k=v,k=v,` with sorted labels."""
    pairs = F.array_join(F.transform(sorted_pairs(labels), lambda p: F.concat(p, F.lit(","))), "")
    return F.concat(rule, F.lit(":"), F.coalesce(pairs, F.lit("")))


def group_key(labels: Column, by: list[str]) -> Column:
    """`k=v` of the grouping labels that are there; `default` without grouping labels."""
    if not by:
        return F.lit("default")
    return F.concat_ws(",", *[F.when(F.map_contains_key(labels, F.lit(k)), F.concat(F.lit(f"{k}="), labels[k])) for k in by])


def condition_holds(value: Column, condition: Column, threshold: Column) -> Column:
    """gt lt eq ne ge le absent present; equality within 1e-9; a null or NaN value is absent and meets nothing else."""
    absent = value.isNull() | F.isnan(value)
    close = F.abs(value - threshold) < 1e-9
    holds = (
        F.when(condition == "gt", value > threshold)
        .when(condition == "lt", value < threshold)
        .when(condition == "eq", close)
        .when(condition == "ne", ~close)
        .when(condition == "ge", value >= threshold)
        .when(condition == "le", value <= threshold)
        .when(condition == "present", F.lit(True))
        .otherwise(F.lit(False))
    )
    return F.when(absent, condition == "absent").otherwise(holds)


def severity_weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, weight in SEVERITIES.items():
        out = F.when(severity == name, F.lit(weight)).otherwise(out)
    return out


def extract_value(kind: Column, value: Column, count: Column, total: Column) -> Column:
    """A counter's or gauge's value; of a histogram or timer its count, else its sum, else 0."""
    return F.when(kind.isin("histogram", "timer"), F.coalesce(count.cast("double"), total.cast("double"), F.lit(0.0))).otherwise(F.coalesce(value.cast("double"), F.lit(0.0)))


def entry_size(key: Column, value: Column, headers: Column | None = None) -> Column:
    """Bytes of a log entry: 24 of header, key, value, and 8 with each header's name and text."""
    size = F.lit(24) + F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))
    if headers is not None:
        size = size + F.aggregate(F.map_entries(headers), F.lit(0), lambda s, e: s + 8 + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return size.cast("long")


def entry_crc(key: Column, value: Column, headers: Column | None = None) -> Column:
    """CRC-32 of key, value and the headers in order of their names."""
    parts = [F.coalesce(key.cast("binary"), F.lit(b"")), F.coalesce(value.cast("binary"), F.lit(b""))]
    if headers is not None:
        parts.append(F.coalesce(F.array_join(sorted_pairs(headers, "%s%s"), ""), F.lit("")).cast("binary"))
    return F.crc32(F.concat(*parts))


# --- conflicting versions of a record ---


def bytes_equal(a: Column, b: Column) -> Column:
    """Null equals empty."""
    return F.coalesce(a.cast("binary"), F.lit(b"")) == F.coalesce(b.cast("binary"), F.lit(b""))


def headers_equal(a: Column, b: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.array_sort(F.map_entries(F.coalesce(a, none))) == F.array_sort(F.map_entries(F.coalesce(b, none)))


def priority(headers: Column) -> Column:
    p = headers["priority"]
    return F.when(p == "high", 3).when(p == "medium", 2).when(p == "low", 1).otherwise(0)


def creation_time(headers: Column, ts: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(headers["creation_time"]), ts.cast("timestamp"))


def vector_clock(headers: Column) -> Column:
    """The `vc_` headers as node -> count; what is not a number is left out."""
    own = F.filter(F.map_entries(headers), lambda e: F.startswith(e["key"], F.lit("vc_")) & e["value"].try_cast("bigint").isNotNull())
    return F.map_from_entries(F.transform(own, lambda e: F.struct(F.substring(e["key"], 4, 2**31 - 1).alias("key"), e["value"].try_cast("bigint").alias("value"))))


def compare_clocks(a: Column, b: Column) -> Column:
    """before, after, concurrent or equal; a node that one side lacks counts as 0 there."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    less, more = F.exists(both, lambda d: d < 0), F.exists(both, lambda d: d > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def splice_insert(value: Column, position: Column, content: Column) -> Column:
    """`content` put in at a 0-based position; null where the position is out of bounds."""
    ok = (position >= 0) & (position <= F.length(value))
    return F.when(ok, F.concat(F.substring(value, F.lit(1), position), content, F.substring(value, position + 1, F.length(value))))


def splice_delete(value: Column, position: Column, length: Column) -> Column:
    ok = (position >= 0) & (length >= 0) & (position + length <= F.length(value))
    return F.when(ok, F.concat(F.substring(value, F.lit(1), position), F.substring(value, position + length + 1, F.length(value))))


def transform_inserts(position: Column, content: Column, other_position: Column, other_content: Column) -> Column:
    """Positions of two concurrent inserts once both apply: the later one shifts, the first yields none at a tie."""
    first = position <= other_position
    return F.struct(
        F.when(first, position).otherwise(position + F.length(other_content)).alias("position"),
        F.when(first, other_position + F.length(content)).otherwise(other_position).alias("other_position"),
    )
