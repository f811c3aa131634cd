"""Text, grid and binary readers as DataFrames.

Paths may be in any store that Spark reads: files come through `spark.read`, never through open().
Formats that need libraries which are not installed (HDF5, NetCDF) are converted to Parquet outside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ascii_columns(spark: SparkSession, path: str, names: list[str] | None = None, columns: list[int] | None = None, comment: str = "#") -> DataFrame:
    """White-space or comma separated numbers: named columns, or one array column `data` without names."""
    return parsed_columns(spark.read.text(path), names, columns, comment)


def parsed_columns(lines: DataFrame, names: list[str] | None = None, columns: list[int] | None = None, comment: str = "#") -> DataFrame:
    """The same of lines (value) that have been read already."""
    lines = lines.where(~F.trim("value").startswith(comment) & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"[\s,;]+")
    if names is None:
        return lines.select(F.transform(parts, lambda x: x.try_cast("double")).alias("data"))
    at = columns or list(range(len(names)))
    return lines.select(*[F.get(parts, F.lit(k)).try_cast("double").alias(n) for n, k in zip(names, at)])


def columns(spark: SparkSession, path: str, names: list[str], sentinels: tuple[float, ...] = ()) -> DataFrame:
    """Named columns of a Parquet point table; NaN and sentinels become NULL."""
    from firnline.functions.columns import nan_to_null

    return nan_to_null(spark.read.parquet(path).select(*names), *sentinels)


def altimeter_heights(df: DataFrame, altitude: str, rng: str, corrections: list[str], flag: str | None = None, good: int = 1, zero_is_missing: tuple[str, ...] = ()) -> DataFrame:
    """Height h = altitude - (range + corrections) of the rows with a good flag; zeros of some columns are missing."""
    out = df if flag is None else df.where(F.col(flag) == good)
    for c in zero_is_missing:
        out = out.withColumn(c, F.nullif(F.col(c), F.lit(0.0)))
    return out.withColumn("h", F.col(altitude) - reduce(lambda a, b: a + F.coalesce(F.col(b), F.lit(0.0)), corrections, F.col(rng)))


def scaled(df: DataFrame, scales: dict[str, float], fill: int = 2147483647) -> DataFrame:
    """Integer fields times their scale, the fill value as NULL."""
    return df.withColumns({c: F.when(F.col(c) != fill, F.col(c) * s) for c, s in scales.items()})


def spread_one_hz(df: DataFrame, one_hz: DataFrame, record: str, times: int, names: list[str]) -> DataFrame:
    """Values given once for every `times` records, joined to each of them."""
    at = one_hz.select(F.col(record).alias("\x01at"), *names)
    return df.join(at, F.floor(F.col(record) / times) == F.col("\x01at"), "left").drop("\x01at")


def beams(tables: dict[str, DataFrame], quality: str, name: str = "beam") -> DataFrame:
    """Beams of one pass as one table, rows that meet the quality predicate; beams that are missing are left out."""
    parts = [t.where(quality).withColumn(name, F.lit(b)) for b, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def grid_rows(df: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """ASCII grids (one file a row, whole text): limits and steps first, then values north to south.

    Columns path, i (west to east), j (south to north), x, y, z; 9999 and above are NULL.
    """
    numbers = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    q = df.select(path, numbers.alias("n"))
    head = {k: F.get("n", F.lit(at)) for at, k in enumerate(("ymin", "ymax", "xmin", "xmax", "dy", "dx"))}
    q = q.withColumns(head)
    nx = F.floor((F.col("xmax") - F.col("xmin")) / F.col("dx") + 0.5).cast("int") + 1
    ny = F.floor((F.col("ymax") - F.col("ymin")) / F.col("dy") + 0.5).cast("int") + 1
    q = q.withColumns({"nx": nx, "ny": ny}).select("*", F.posexplode(F.slice("n", 7, F.size("n"))).alias("at", "z"))
    i, j = F.col("at") % F.col("nx"), F.col("ny") - 1 - F.floor(F.col("at") / F.col("nx"))
    return q.select(path, i.cast("int").alias("i"), j.cast("int").alias("j"), (F.col("xmin") + i * F.col("dx")).alias("x"), (F.col("ymin") + j * F.col("dy")).alias("y"), F.when(F.col("z") < 9999, F.col("z")).alias("z"))


def read_ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return grid_rows(files)


def tide_grids(spark: SparkSession, path: str) -> DataFrame:
    """Tide-model depth grids in big-endian records: path, i, j, lon, lat, depth, mask. One task a file."""
    import pyarrow as pa

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                nx, ny = np.frombuffer(raw, ">i4", 2, 4)
                ylim, xlim = np.frombuffer(raw, ">f4", 2, 12), np.frombuffer(raw, ">f4", 2, 20)
                nob = int(np.frombuffer(raw, ">i4", 1, 32)[0])
                at = 36 + (20 if nob == 0 else 8 + 8 * nob + 8)
                depth = np.frombuffer(raw, ">f4", nx * ny, at).astype(float)
                mask = np.frombuffer(raw, ">i4", nx * ny, at + 4 * nx * ny + 8).astype(np.int32)
                j, i = np.divmod(np.arange(nx * ny), nx)
                dx, dy = (xlim[1] - xlim[0]) / nx, (ylim[1] - ylim[0]) / ny
                lon, lat = xlim[0] + (i + 0.5) * dx, ylim[0] + (j + 0.5) * dy
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(i)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(lon.astype(float)), pa.array(lat.astype(float)), pa.array(depth), pa.array(mask)], names=["path", "i", "j", "lon", "lat", "depth", "mask"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "path string, i int, j int, lon double, lat double, depth double, mask int")


def load_window(df: DataFrame, xlim: tuple[float, float], ylim: tuple[float, float], step: int = 1) -> DataFrame:
    """Cells of a raster inside a box, every `step`-th row and column; the box reaches the Parquet scan."""
    out = df.where(F.col("x").between(*xlim) & F.col("y").between(*ylim))
    return out if step == 1 else out.where((F.col("i") % step == 0) & (F.col("j") % step == 0))


def name_fields(path: Column) -> dict[str, Column]:
    """Tile number, box, buffer and EPSG code from a tile's file name; NULL where the name has none."""
    def number(key: str, pattern: str = r"(-?\d+(?:\.\d+)?)") -> Column:
        return F.nullif(F.regexp_extract(path, key + pattern, 1), F.lit("")).try_cast("double")

    box = r"bbox_(-?[\d.]+)_(-?[\d.]+)_(-?[\d.]+)_(-?[\d.]+?)(?=_|\.[a-z])"
    sides = {n: F.nullif(F.regexp_extract(path, box, k), F.lit("")).try_cast("double") for k, n in enumerate(("xmin", "xmax", "ymin", "ymax"), 1)}
    return {"tile": number("tile_").cast("int"), "buffer": number("buff_"), "epsg": number("epsg_").cast("int")} | sides


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path that match a pattern, in natural order of their tile number, with their size."""
    q = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
    return q.withColumns(name_fields(F.col("path"))).withColumn("empty", F.col("length") == 0)


def tide_elevations(spark: SparkSession, path: str) -> DataFrame:
    """Constituent grids in big-endian records: path, constituent, i, j, re, im; 0 means no tide there (NULL).

    A file holds its header record (sizes, limits, names of four letters) and a record of interleaved real
    and imaginary parts for each constituent. One task a file; constituents are emitted one at a time.
    """
    import pyarrow as pa

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_buffer()
                header, nx, ny, nc = (int(v) for v in np.frombuffer(raw, ">i4", 4))
                names = bytes(raw[32 : 32 + 4 * nc]).decode("ascii")
                first = 32 + (header - 28) + 8
                j, i = np.divmod(np.arange(nx * ny, dtype=np.int32), nx)
                for k in range(nc):
                    parts = np.frombuffer(raw, ">f4", 2 * nx * ny, first + k * (8 * nx * ny + 8)).astype(float).reshape(-1, 2)
                    void = (parts == 0).all(axis=1)
                    cols = [pa.array([name] * len(i)), pa.array([names[4 * k : 4 * k + 4].strip()] * len(i)), pa.array(i), pa.array(j), pa.array(parts[:, 0], mask=void), pa.array(parts[:, 1], mask=void)]
                    yield pa.RecordBatch.from_arrays(cols, names=["path", "constituent", "i", "j", "re", "im"])

    files_ = spark.read.format("binaryFile").load(path).select("path", "content")
    return files_.mapInArrow(decode, "path string, constituent string, i int, j int, re double, im double")


def _records(raw: bytes) -> Iterator[bytes]:
    """The records of a file in which each stands between two copies of its length."""
    at = 0
    while at + 4 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        if raw[at + 4 + size : at + 8 + size] != raw[at : at + 4]:
            raise ValueError(f"no record at byte {at}")
        yield raw[at + 4 : at + 4 + size]
        at += size + 8


def compact_tide_elevations(spark: SparkSession, path: str) -> DataFrame:
    """Constituents of compact tide models: path, patch, name, constituent, i, j, lon, lat, re, im.

    A file holds a global grid (patch 0, no name), as `tide_elevations` reads it, and then local patches, numbered in
    order: a header (sizes, limits, names of the constituents and of the patch), the places of their wet cells, and a record
    of these cells' values for each constituent. lon and lat are cells' centres; global cells without a tide have
    NULLs, of patches only wet cells have rows. One task a file; constituents are emitted one at a time.
    """
    import pyarrow as pa

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def rows(file, patch, name, constituent, i, j, size, limits, values):
            (lat0, lat1), (lon0, lon1) = limits
            lon, lat = lon0 + (i + 0.5) * (lon1 - lon0) / size[0], lat0 + (j + 0.5) * (lat1 - lat0) / size[1]
            void = (values == 0).all(axis=1) if not patch else None
            same = lambda v, kind: pa.array([v] * len(i), kind)
            cols = [same(file, pa.string()), same(patch, pa.int32()), same(name, pa.string()), same(constituent, pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(lon), pa.array(lat), pa.array(values[:, 0], mask=void), pa.array(values[:, 1], mask=void)]
            return pa.RecordBatch.from_arrays(cols, names=["path", "patch", "name", "constituent", "i", "j", "lon", "lat", "re", "im"])

        def limits(record, at):
            return np.frombuffer(record, ">f4", 4, at).astype(float).reshape(2, 2)

        def names(record, at, n):
            return [record[at + 4 * k : at + 4 * k + 4].decode("ascii").strip() for k in range(n)]

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                records = _records(content.as_py())
                head = next(records)
                nx, ny, nc = (int(v) for v in np.frombuffer(head, ">i4", 3))
                j, i = np.divmod(np.arange(nx * ny), nx)
                for constituent in names(head, 28, nc):
                    yield rows(file, 0, None, constituent, i, j, (nx, ny), limits(head, 12), np.frombuffer(next(records), ">f4").astype(float).reshape(-1, 2))
                patch = 0
                for head in records:
                    patch += 1
                    nx, ny, nc, n = (int(v) for v in np.frombuffer(head, ">i4", 4))
                    name = head[32 + 4 * nc : 52 + 4 * nc].decode("ascii").strip()
                    places = np.frombuffer(next(records), ">i4").astype(np.int64)
                    for constituent in names(head, 32, nc):
                        yield rows(file, patch, name, constituent, places[:n] - 1, places[n : 2 * n] - 1, (nx, ny), limits(head, 16), np.frombuffer(next(records), ">f4").astype(float).reshape(-1, 2))

    files_ = spark.read.format("binaryFile").load(path).select("path", "content")
    return files_.mapInArrow(decode, "path string, patch int, name string, constituent string, i int, j int, lon double, lat double, re double, im double")


def amplitude_phase_grids(spark: SparkSession, path: str, missing: float = 999.0, header: int = 7) -> DataFrame:
    """ASCII grids of amplitude and then phase (degrees), each after its header lines: path, i, j, re, im.

    The third header line has rows and columns. Compressed files are read as Spark reads them.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n").alias("lines"))
    size = F.transform(F.filter(F.split(F.trim(F.get("lines", F.lit(2))), r"\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    q = whole.withColumn("size", size).withColumns({"ny": F.get("size", F.lit(0)), "nx": F.get("size", F.lit(1))})
    half = F.floor(F.size(F.filter("lines", lambda x: F.trim(x) != "")) / 2).cast("int")

    def numbers(start: Column) -> Column:
        text = F.array_join(F.slice("lines", start + header + 1, half - header), " ")
        return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))

    q = q.select("path", "nx", F.posexplode(F.zip_with(numbers(F.lit(0)), numbers(half), lambda a, p: F.struct(a.alias("a"), p.alias("p")))).alias("at", "v"))
    ok = (F.col("v.a") < missing) & (F.col("v.p") < missing)
    lag = F.radians("v.p")
    return q.select("path", (F.col("at") % F.col("nx")).cast("int").alias("i"), F.floor(F.col("at") / F.col("nx")).cast("int").alias("j"), F.when(ok, F.col("v.a") * F.cos(lag)).alias("re"), F.when(ok, -F.col("v.a") * F.sin(lag)).alias("im"))


def lidar_heights(df: DataFrame, h: str, put_back: list[str], add: list[str], subtract: list[str], predicates: list[str]) -> DataFrame:
    """Heights of rows that meet the predicates, with applied corrections put back, others added and taken off."""
    out = reduce(lambda d, p: d.where(p), predicates, df)
    terms = [F.coalesce(F.col(c), F.lit(0.0)) for c in [*put_back, *add]] + [-F.coalesce(F.col(c), F.lit(0.0)) for c in subtract]
    return out.withColumn(h, reduce(lambda a, b: a + b, terms, F.col(h)))


def heights_with_sentinels(df: DataFrame, h: str, add: list[str], subtract: list[str], missing: float = -9999.0) -> DataFrame:
    """Heights with corrections that count only where they are not the missing value."""
    def some(c: str) -> Column:
        return F.when(F.col(c) != missing, F.col(c)).otherwise(F.lit(0.0))

    return df.withColumn(h, reduce(lambda a, b: a + b, [some(c) for c in add] + [-some(c) for c in subtract], F.col(h)))
