"""Paths by time: patterns of %Y %m %d %H and %%, expanded over a time range at their smallest unit."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession

from ..plans.model import EngineError, parse_time

#: The conversions, from the largest unit to the smallest, each with its strftime text.
UNITS = ("Y", "m", "d", "H")


def check_pattern(pattern: str) -> str | None:
    """The smallest unit that a pattern uses, or None."""
    used, at = set(), 0
    while (at := pattern.find("%", at)) >= 0:
        kind = pattern[at + 1 : at + 2]
        if not kind:
            raise EngineError(f'unexpected "%" at char {at + 1}')
        if kind != "%" and kind not in UNITS:
            raise EngineError(f'unsupported conversion "%{kind}" at char {at + 1}')
        used.add(kind)
        at += 2
    return next((u for u in reversed(UNITS) if u in used), None)


def _floor(t: datetime, unit: str) -> datetime:
    keep = UNITS.index(unit)
    return t.replace(month=t.month if keep >= 1 else 1, day=t.day if keep >= 2 else 1, hour=t.hour if keep >= 3 else 0, minute=0, second=0, microsecond=0)


def _next(t: datetime, unit: str) -> datetime:
    if unit == "Y":
        return t.replace(year=t.year + 1)
    if unit == "m":
        return t.replace(year=t.year + t.month // 12, month=t.month % 12 + 1)
    return t + (timedelta(days=1) if unit == "d" else timedelta(hours=1))


def enumerate_paths(pattern: str, start, end) -> list[str]:
    """Paths that can hold times from ``start`` to before ``end``; that of ``start`` always."""
    first, last = (t if isinstance(t, int) else parse_time(t, n) for t, n in ((start, "timeStart"), (end, "timeEnd")))
    if first > last:
        raise EngineError('"timeStart" may not be after "timeEnd"')
    unit = check_pattern(pattern)
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    at, stop = epoch + timedelta(milliseconds=first), epoch + timedelta(milliseconds=last)
    if unit is None:
        return [at.strftime(pattern)]
    at, out = _floor(at, unit), []
    while not out or at < stop:
        # Years of fewer than four digits are padded everywhere alike.
        out.append(at.strftime(pattern.replace("%Y", f"{at.year:04d}")))
        at = _next(at, unit)
    return out


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that exist; others hold no data. Of many paths, each folder above them is listed once, from the top."""
    if len(paths) <= 4:
        return [p for p in paths if (at := hadoop(spark, p))[0].exists(at[1])]
    listed: dict[str, set[str]] = {}

    def names(folder: str, depth: int) -> set[str]:
        if folder not in listed:
            above, _, own = folder.rpartition("/")
            # A folder that is not in the one above it needs no call.
            there = depth == 0 or not own or "://" not in above + "/x" and not above or own in names(above, depth - 1)
            fs, at = hadoop(spark, folder or "/")
            listed[folder] = {s.getPath().getName() for s in fs.listStatus(at)} if there and fs.exists(at) else set()
        return listed[folder]

    levels = 2  # above a pattern's last part there may be folders by day and by year
    return [p for p in paths if p.rpartition("/")[2] in names(p.rpartition("/")[0], levels)]


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text from any file system; None where there is none."""
    fs, at = hadoop(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place, then move it there."""
    fs, at = hadoop(spark, path)
    _, beside = hadoop(spark, path + ".new")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(at), over)
