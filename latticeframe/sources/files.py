"""Text sources and sinks: voxel CSV, load-step text, property and probability CSV, dense arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticeframe.functions.scalar import STORED

#: The load-step format's field width and stride, and the CSV headers.
WIDTH, STRIDE = 16, 17
VOXEL_HEADER = {"x": "X", "y": "Y", "z": "Z", "grain": "Colors"}
PROPERTY_HEADER = {"norm_area": "NormArea", "perimeter": "Perimeter", "shape_factor": "Shape Factor", "ecr": "ECR", "volume": "Volume", "norm_volume": "NormVolume", "surface_area": "SurfaceArea", "inertia": "MomentInertia3D", "esr": "ESR"}
PROBABILITY_HEADER = {"i": "X", "j": "Y", "k": "Z", "probability": "Probability"}


def _renamed(df: DataFrame, header: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).alias(name) for c, name in header.items()))


def write_voxel_csv(voxels: DataFrame, path: str) -> None:
    """`;` separated cells in the order x, y, z."""
    _renamed(voxels, VOXEL_HEADER).orderBy("X", "Y", "Z").write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def read_voxel_csv(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.schema("X long, Y long, Z long, Colors long").option("sep", ";").option("header", True).csv(path)
    return read.select(*(F.col(name).alias(c) for c, name in VOXEL_HEADER.items()))


def write_property_csv(properties: DataFrame, path: str) -> None:
    _renamed(properties, PROPERTY_HEADER).write.mode("overwrite").option("header", True).csv(path)


def write_probability_csv(cells: DataFrame, path: str) -> None:
    """The 27 rows as one file; the writer's commit takes the place of a rename."""
    _renamed(cells.orderBy("i", "j", "k"), PROBABILITY_HEADER).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


LINE = ["%16.0f"] + ["%16.8E"] * (len(STORED) - 1)
NUMBER = r"^-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"


#: Powers of ten that doubles hold exactly, and texts by number as integers of four bytes: four digits, the beginning of a
#: field by its sign and first digit, its exponent.
POWERS = 10.0 ** np.arange(23)
FOUR = np.frombuffer("".join(f"{i:04d}" for i in range(10_000)).encode(), "<u4")
HEADS = np.frombuffer("".join(f" {sign}{digit}." for sign in " -" for digit in range(10)).encode(), "<u4")
EXPONENTS = np.frombuffer("".join(f"E{e:+03d}" for e in range(-99, 100)).encode(), "<u4")
FIELD = np.dtype({"names": ["head", "high", "low", "exponent", "end"], "formats": ["<u4"] * 4 + ["u1"], "offsets": [0, 4, 8, 12, 16], "itemsize": STRIDE})


def _text(rows: list[tuple]) -> pa.Array:
    """Rows as lines, number by number; a missing value is written as NULL."""
    null = " " * (WIDTH - 4) + "NULL"
    return pa.array(["".join((null if v is None else form % v) + ";" for form, v in zip(LINE, row, strict=True)) for row in rows], pa.string())


def _line(*columns: pa.Array) -> pa.Array:
    """The nodes' fields as lines. Digits are taken for all rows at once; a row with a value that is missing or not finite, with
    an exponent beyond the powers of ten that are exact, or so near the middle of two texts that a double's product can't
    tell them apart, is written number by number."""
    rows = len(columns[0])
    out = np.empty((rows, len(LINE)), FIELD)
    out["end"] = ord(";")
    ids, values = columns[0].to_numpy(zero_copy_only=False).astype(float), np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns[1:]], axis=1)
    with np.errstate(all="ignore"):
        sound = (ids >= 0) & (ids < 2**53) & (ids == np.rint(ids)) & ~np.signbit(ids)
        whole = np.where(sound, ids, 0).astype(np.int64)
        size = np.abs(values)
        zero = size == 0
        exponent = np.where(zero, 0, np.floor(np.log10(size)))
        known = np.abs(8 - exponent) < len(POWERS) - 1
        exponent = np.where(known, exponent, 0).astype(np.int64)
        scaled = lambda e: np.where(e <= 8, size * POWERS[np.maximum(8 - e, 0)], size / POWERS[np.maximum(e - 8, 0)])
        digits = scaled(exponent)
        off = (digits >= 1e9).astype(np.int64) - ((digits < 1e8) & ~zero)  # the logarithm may be one off
        if off.any():
            exponent += np.where(known, off, 0)
            digits = scaled(exponent)
        nearest = np.rint(digits)
        known &= (zero | (nearest >= 1e8) & (nearest <= 1e9)) & (np.abs(np.abs(digits - nearest) - 0.5) > 1e-6)
        nearest = np.where(known, nearest, 0).astype(np.int64)
    over = nearest == 10**9
    if over.any():
        nearest[over], exponent[over] = 10**8, exponent[over] + 1
    first, rest = np.divmod(nearest, 10**8)
    high, low = np.divmod(rest, 10**4)
    fields = out[:, 1:]
    fields["head"], fields["high"], fields["low"] = HEADS[first + 10 * np.signbit(values)], FOUR[high], FOUR[low]
    fields["exponent"] = EXPONENTS[exponent + 99]
    for name, power in zip(("head", "high", "low", "exponent"), (12, 8, 4, 0), strict=True):
        out[name][:, 0] = FOUR[whole // 10**power % 10**4]
    text = out.view(np.uint8).reshape(rows, STRIDE * len(LINE))
    blanks = WIDTH - np.maximum(1, np.searchsorted(10 ** np.arange(WIDTH), whole, "right"))
    text[:, :WIDTH][np.arange(WIDTH) < blanks[:, None]] = ord(" ")
    ends = np.arange(0, text.size + 1, text.shape[1], dtype=np.int32)
    lines = pa.StringArray.from_buffers(rows, pa.py_buffer(ends), pa.py_buffer(text))
    odd = ~(sound & known.all(axis=1))
    for c in columns:
        if c.null_count:
            odd |= c.is_null().to_numpy(zero_copy_only=False)
    if not odd.any():
        return lines
    single = pa.table(list(columns), names=[*STORED]).filter(pa.array(odd))
    return pc.replace_with_mask(lines, pa.array(odd), _text(list(zip(*(c.to_pylist() for c in single.columns), strict=True))))


def write_loadsteps(nodes: DataFrame, path: str, file_ids: int = 1_000_000, compression: str = "none") -> None:
    """Text of fixed-width fields: a folder `ls=<n>` for each load step, in it a folder `ids=<b>` for each `file_ids` ids,
    in that one file, a header line first, then the nodes in order of id. Load steps are few, so it is the ranges of ids
    that spread the work. Readers take the step from the path, as in files `ls_<n>.csv`, and unpack compressed files by
    their names; as one of these is read by one task, they should be of fewer ids."""
    line = F.arrow_udf(_line, "string")(*(F.col(c).cast("double") for c in STORED))
    header = ";".join(c.rjust(WIDTH) for c in STORED) + ";"
    # numbers are exchanged, as lines are longer; making lines keeps neither their place nor their order in Spark's eyes, so the
    # first of a file is told before, and lines are sorted again, which costs little where they are in order
    dealt = nodes.select(F.col("load_step").alias("ls"), F.floor(F.col("id") / file_ids).cast("long").alias("ids"), *STORED).repartition("ls", "ids")
    first = F.row_number().over(W.partitionBy("ls", "ids").orderBy("id")) == 1
    rows = dealt.withColumn("first", first).select("ls", "ids", F.col("id").alias("k"), "first", line.alias("value")).sortWithinPartitions("ls", "ids", "k")
    value = F.when(F.col("first"), F.concat(F.lit(header + "\n"), "value")).otherwise(F.col("value"))
    rows.select("ls", "ids", value.alias("value")).write.mode("overwrite").option("compression", compression).partitionBy("ls", "ids").text(path)


def _plain_numbers(lines: pa.Array) -> np.ndarray:
    """The 19 numbers of each line, NaN where a field is none that is written plainly."""
    columns = []
    for j in range(len(STORED)):
        field = pc.utf8_trim(pc.utf8_slice_codeunits(lines, j * STRIDE, j * STRIDE + WIDTH), " ")
        plain = pc.if_else(pc.match_substring_regex(field, NUMBER), field, pa.scalar(None, field.type))
        columns.append(pc.cast(plain, pa.float64()).to_numpy(zero_copy_only=False))
    return np.stack(columns, axis=1)


def _eight(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of eight bytes, as integers, as numbers, and whether they are digits alone."""
    digits = text ^ np.uint64(0x3030303030303030)
    sound = ((digits + np.uint64(0x7676767676767676) | digits) & np.uint64(0x8080808080808080)) == 0
    digits = (digits & np.uint64(0x0F0F0F0F0F0F0F0F)) * np.uint64(2561) >> np.uint64(8)
    digits = (digits & np.uint64(0x00FF00FF00FF00FF)) * np.uint64(6553601) >> np.uint64(16)
    return ((digits & np.uint64(0x0000FFFF0000FFFF)) * np.uint64(42949672960001) >> np.uint64(32)).astype(np.int64), sound


def _written_numbers(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 19 numbers of lines as write_loadsteps writes them, from their bytes, and which lines are such. Nine digits and a
    power of ten that doubles hold exactly give the nearest double by one product or quotient."""
    rows = len(text)
    fields = text.reshape(-1).view(FIELD).reshape(rows, len(LINE))
    head, exponent = fields["head"][:, 1:] - HEADS[0], fields["exponent"][:, 1:] - EXPONENTS[99]
    sign, first = head & 0xFFFF, head >> 16
    tens, ones = exponent >> 16 & 0xFF, exponent >> 24
    rest, sound = _eight(text.reshape(-1).view(np.dtype({"names": ["digits"], "formats": ["<u8"], "offsets": [4], "itemsize": STRIDE}))["digits"].reshape(rows, len(LINE))[:, 1:])
    sound &= ((sign == 0) | (sign == 0x0D00)) & (first <= 9) & (tens <= 9) & (ones <= 9)
    down = exponent & 0xFFFF
    sound &= (down == 0) | (down == 0x0200)
    power = np.where(down == 0, 1, -1) * (10 * tens.astype(np.int64) + ones) - 8
    sound &= np.abs(power) < len(POWERS)
    power[~sound] = 0
    size = (first.astype(np.int64) * 10**8 + rest).astype(float)
    size = np.where(power >= 0, size * POWERS[np.maximum(power, 0)], size / POWERS[np.maximum(-power, 0)])
    ids = text[:, :WIDTH]
    blank = ids == ord(" ")
    (high, sound_high), (low, sound_low) = (_eight(np.ascontiguousarray((ids | 0x10)[:, k : k + 8]).view("<u8")[:, 0]) for k in (0, 8))
    whole = high * 10**8 + low
    right = ~blank[:, -1] & ~(blank[:, 1:] & ~blank[:, :-1]).any(axis=1) & (whole < 2**53) & sound_high & sound_low & ((ids >= ord("0")) | blank).all(axis=1)
    numbers = np.concatenate([whole[:, None].astype(float), np.where(sign == 0, size, -size)], axis=1)
    return numbers, right & sound.all(axis=1) & (fields["end"] == ord(";")).all(axis=1)


def _numbers(lines: pa.Array) -> pa.Array:
    """The 19 numbers of each line; null where a field is none that is written plainly. Lines as write_loadsteps writes them are
    read from their bytes at once."""
    lines, wide = lines.cast(pa.string()), STRIDE * len(LINE)
    ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, np.int32)
    like, numbers = np.diff(ends) == wide, np.full((len(lines), len(LINE)), np.nan)
    if lines.null_count:
        like &= lines.is_valid().to_numpy(zero_copy_only=False)
    if like.any():
        text = np.frombuffer(lines.buffers()[2], np.uint8)
        text = text[ends[0] : ends[-1]].reshape(-1, wide) if like.all() else text[ends[:-1][like][:, None] + np.arange(wide)]
        found, sound = _written_numbers(text)
        like[like] = sound
        numbers[like] = found[sound]
    if not like.all():
        numbers[~like] = _plain_numbers(lines.filter(pa.array(~like)))
    ends = np.arange(0, numbers.size + 1, len(STORED), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers.ravel()), mask=pa.array(~np.isfinite(numbers).all(axis=1)))


def judged_loadsteps(lines: DataFrame) -> DataFrame:
    """Lines (value, path) as (value, path, load_step, fields, reason): an array of 19 numbers, of 16 characters every 17, and
    the load step from the path. reason is null for a sound line, else `header`, `short`, `load step` or the first field
    that is no number.

    Lines of plain numbers are read in bulk, once for all uses; the others field by field."""
    # declared as not deterministic, so that a filter by the reason does not read the fields a second time
    bulk = F.arrow_udf(_numbers, "array<double>").asNondeterministic()
    number = lambda j: F.trim(F.substring(F.col("value"), j * STRIDE + 1, F.lit(WIDTH))).try_cast("double")
    single = F.transform(F.sequence(F.lit(0), F.lit(len(STORED) - 1)), number)
    step = F.regexp_extract("path", r"ls[_=](\d+)", 1).try_cast("int")
    read = lines.select("value", "path", step.alias("load_step"), bulk("value").alias("bulk"))
    read = read.select("value", "path", "load_step", F.coalesce("bulk", single).alias("fields"), F.col("bulk").isNull().alias("odd"))
    short = F.length("value") < STRIDE * (len(STORED) - 1) + WIDTH
    reason = F.when(F.col("odd") & (F.trim(F.substring("value", 1, WIDTH)) == STORED[0]), "header").when(short, "short").when(F.col("load_step").isNull(), "load step")
    faulty = F.when(F.col("odd"), F.array_position(F.transform("fields", lambda v: v.isNull()), True))
    return read.withColumn("reason", reason.when(faulty > 0, F.array(*map(F.lit, STORED))[(faulty - 1).cast("int")])).drop("odd")


def parse_loadsteps(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Sound lines (value, path) as node rows. `counts` observes, in the same pass, how many lines were nodes, headers and
    rejected."""
    judged = judged_loadsteps(lines)
    if counts is not None:
        of = lambda c: F.count_if(c)
        bad = F.coalesce(F.col("reason") != "header", F.lit(False))
        judged = judged.observe(counts, of(F.col("reason").isNull()).alias("nodes"), of(F.col("reason") == "header").alias("headers"), of(bad).alias("rejected"))
    field = lambda c: F.col("fields")[STORED.index(c)]
    return judged.where(F.col("reason").isNull()).select("load_step", field("id").cast("long").alias("id"), *(field(c).alias(c) for c in STORED[1:]))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))


def read_loadsteps(spark: SparkSession, path: str, counts: Observation | None = None) -> DataFrame:
    """The nodes of all sound lines under a path; see parse_loadsteps."""
    return parse_loadsteps(_lines(spark, path), counts)


def rejected_loadsteps(spark: SparkSession, path: str) -> DataFrame:
    """(path, load_step, id, reason, value) of the lines under a path that are neither nodes nor headers; id where it can
    be read."""
    rejected = judged_loadsteps(_lines(spark, path)).where("reason <> 'header'")
    return rejected.select("path", "load_step", F.col("fields")[0].cast("long").alias("id"), "reason", "value")


def dense_array_unpack(arrays: DataFrame, column: str) -> DataFrame:
    """(other columns, x, y, z, value) of an array nested three deep."""
    rest = [c for c in arrays.columns if c != column]
    a = arrays.select(*rest, F.posexplode(column).alias("x", "a"))
    b = a.select(*rest, "x", F.posexplode("a").alias("y", "b"))
    return b.select(*rest, "x", "y", F.posexplode("b").alias("z", "value"))


def flat_array_unpack(arrays: DataFrame, column: str, d1: int, d2: int) -> DataFrame:
    """As dense_array_unpack from a flat row-major array: position = x * d1 * d2 + y * d2 + z."""
    rest = [c for c in arrays.columns if c != column]
    flat = arrays.select(*rest, F.posexplode(column).alias("p", "value"))
    return flat.select(*rest, F.floor(F.col("p") / (d1 * d2)).cast("int").alias("x"), (F.floor(F.col("p") / d2) % d1).cast("int").alias("y"), (F.col("p") % d2).alias("z"), "value")


def dense_array_pack(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells to lines along z: (keys, x, y, values in the order of z). Lines rather than cubes keep a row small at any size."""
    packed = cells.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_list(F.struct(F.col("z"), F.col(value).alias("v")))).alias("s"))
    return packed.select(*keys, "x", "y", F.col("s.v").alias("values"))


def dense_cube_pack(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells to one array nested three deep for each key, for arrays that fit a row: dense_array_unpack's inverse. Lines are
    packed first, then planes, then cubes."""
    lines = dense_array_pack(cells, keys, value)
    planes = lines.groupBy(*keys, "x").agg(F.array_sort(F.collect_list(F.struct("y", "values"))).alias("p"))
    cubes = planes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", F.col("p.values").alias("plane")))).alias("c"))
    return cubes.select(*keys, F.col("c.plane").alias("cube"))
