"""Binary and text frames of edge devices as Column expressions: numbers from bytes, dispatch by the tag byte, and the two
forms of remote-control packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the first byte of a frame says of the rest.
TAGS = {"00": "json", "01": "video", "02": "sensor_data", "03": "heartbeat", "04": "remote_control"}


def unsigned(data: Column, start: int, size: int) -> Column:
    """A big-endian unsigned number of up to 7 bytes, from the 1-based place."""
    return F.conv(F.hex(F.substring(data, start, size)), 16, 10).cast("long")


def big_endian_double(data: Column, start: int = 1) -> Column:
    """The IEEE 754 double in the 8 bytes from the 1-based place, exactly; null if they are not all there. Sign and
    exponent are the first 12 bits, the rest is the fraction: each step is a whole number or a power of two."""
    head, rest = unsigned(data, start, 2), unsigned(data, start + 1, 7)
    sign = F.when(F.shiftright(head, 15) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(head, 4).bitwiseAND(F.lit(0x7FF))
    fraction = rest.bitwiseAND(F.lit(0xFFFFFFFFFFFFF))
    two = F.lit(2.0)
    # The power in two steps, as one alone may be below the smallest double.
    normal = (fraction + F.lit(1 << 52)).cast("double") * F.pow(two, F.greatest(exponent - 1075, F.lit(-537))) * F.pow(two, F.least(exponent - 1075 + 537, F.lit(0)))
    value = (
        F.when((exponent == 2047) & (fraction > 0), float("nan")).when(exponent == 2047, float("inf"))
        .when(exponent == 0, fraction.cast("double") * F.pow(two, F.lit(-537)) * F.pow(two, F.lit(-537))).otherwise(normal)
    )
    return F.when(F.length(data) >= start + 7, sign * value)


def frames(rows: DataFrame, data: str = "data", keep: tuple[str, ...] = ("edge_id",)) -> DataFrame:
    """Frames (binary, a tag byte and a payload) taken apart: keep, kind (null for unknown tags), taken_at and size of a
    video frame's picture, latency_ms of a heartbeat (0 without a payload), json of the others. Frames of a single byte are
    dropped."""
    tag = F.hex(F.substring(F.col(data), 1, 1))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair]), tag)
    n = F.length(data)
    rest = F.expr(f"substring(`{data}`, 2)")
    text = F.decode(rest, "UTF-8")
    return rows.filter(n > 1).select(
        *keep, kind.alias("kind"), F.when(kind == "video", big_endian_double(F.col(data), 2)).alias("taken_at"), F.when(kind == "video", F.greatest(n - 9, F.lit(0))).cast("long").alias("size"),
        F.when(kind == "heartbeat", text.try_cast("double")).alias("latency_ms"), F.when(kind.isin("json", "sensor_data", "remote_control"), text).alias("json"),
    )


def control_packet(line: Column) -> Column:
    """channels (1 to 10, null where not named) and switches (7 flags) of a packet, whichever form it has: a line `DATA n
    CH1:1500 ... SW:0001000`, or JSON with channels and switches. Null for anything else. In a line, of a channel named twice
    the last counts; switches not of 7 characters are none."""
    words = F.filter(F.slice(F.split(F.trim(line), r"\s+"), 3, 1000), lambda w: F.contains(w, F.lit(":")))
    number = lambda w: F.regexp_extract(w, r"^[^:]*:(-?[0-9]+)$", 1).try_cast("int")

    def channel(c: int) -> Column:
        own = F.filter(words, lambda w: (F.substring_index(w, ":", 1) == f"CH{c}") & number(w).isNotNull())
        return number(F.try_element_at(own, F.lit(-1)))

    channels = F.array(*map(channel, range(1, 11)))
    flags = F.regexp_extract(F.try_element_at(F.filter(words, lambda w: (F.substring_index(w, ":", 1) == "SW") & (F.length(w) == 10)), F.lit(-1)), r"^SW:(.{7})$", 1)
    switches = F.when(F.length(flags) == 7, F.transform(F.split(flags, ""), lambda c: c == "1"))
    text = F.struct(channels.alias("channels"), switches.alias("switches"))
    parsed = F.from_json(line, "channels array<int>, switches array<boolean>")
    padded = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.get(parsed["channels"], i - 1))
    return F.when(line.startswith("DATA") & (F.size(F.split(F.trim(line), r"\s+")) >= 3), text).when(line.startswith("{") & parsed["channels"].isNotNull(), F.struct(padded.alias("channels"), parsed["switches"].alias("switches")))
