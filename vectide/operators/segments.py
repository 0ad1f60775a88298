"""Time segmentation of media, as generators over positions, and pooling of segments' vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_rate(rational: Column) -> Column:
    """``"30000/1001"`` as a number; null where it isn't one."""
    return F.try_divide(F.split_part(rational, F.lit("/"), F.lit(1)).cast("double"), F.coalesce(F.nullif(F.split_part(rational, F.lit("/"), F.lit(2)), F.lit("")).cast("double"), F.lit(1.0)))


def frames(df: DataFrame, id_col: str, frame_count: Column, fps: Column, interval: float = 2.0) -> DataFrame:
    """(id, seq, position, start, name): a frame every ``interval`` seconds; positions are cut to whole frames."""
    step = fps * F.lit(interval)
    n = F.ceil(frame_count / step).cast("int")
    return (
        df.select(F.col(id_col), step.alias("step"), fps.alias("fps"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("seq"))
        .select(id_col, "seq", (F.col("seq") * F.col("step")).cast("bigint").alias("position"), "fps")
        .select(id_col, "seq", "position", (F.col("position") / F.col("fps")).alias("start"), F.format_string("frame_%04d.png", "seq").alias("name"))
    )


def clips(df: DataFrame, id_col: str, samples: Column, step: Column | int) -> DataFrame:
    """(id, seq, name, samples): non-overlapping clips of ``step`` samples; the last may be short."""
    width = F.lit(step) if isinstance(step, int) else step
    n = F.ceil(F.size(samples) / width).cast("int")
    return (
        df.select(F.col(id_col), samples.alias("_s"), width.alias("_w"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("seq"))
        .select(id_col, "seq", F.format_string("audio_%04d.wav", "seq").alias("name"), F.slice("_s", F.col("seq") * F.col("_w").cast("int") + 1, F.col("_w").cast("int")).alias("samples"))
    )


def text_segments(df: DataFrame, id_col: str, text: str, width: int = 500) -> DataFrame:
    """(id, seq, start, segment): the half-open intervals of a text, all of it."""
    n = F.ceil(F.length(text) / F.lit(width)).cast("int")
    return (
        df.select(F.col(id_col), F.col(text).alias("_t"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("seq"))
        .select(id_col, "seq", (F.col("seq") * width).alias("start"), F.substring("_t", F.col("seq") * width + 1, F.lit(width)).alias("segment"))
    )


def pool(df: DataFrame, key: str, vector: str, digits: int = 6) -> DataFrame:
    """(key, pos, value): element-wise means of a group's vectors. The sums are map-side; a group's vectors never meet."""
    return df.select(F.col(key), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x")).groupBy(key, "pos").agg(F.round(F.avg("x"), digits).alias("value"))


def pooled_vectors(pooled: DataFrame, key: str) -> DataFrame:
    """One row a key: its pooled vector as an array."""
    return pooled.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("vector"))


def demux(df: DataFrame, id_col: str, frame_count: Column, fps: Column, samples: Column, rate: Column, interval: float = 2.0) -> DataFrame:
    """(id, data, type): the names of a file's frames and of its clips, a row for each file and modality; none is an empty list, and null where it isn't known how many there are."""

    def names(n: Column, form: str) -> Column:
        n = n.cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.format_string(form, i))).when(n <= 0, F.array().cast("array<string>"))

    many = F.when(samples.isNotNull(), F.size(samples))
    pictures = names(F.ceil(frame_count / (fps * F.lit(interval))), "frame_%04d.png")
    sounds = names(F.ceil(many / F.floor(rate * F.lit(interval))), "audio_%04d.wav")
    both = F.array(F.struct(pictures.alias("data"), F.lit("image").alias("type")), F.struct(sounds.alias("data"), F.lit("audio").alias("type")))
    return df.select(id_col, F.explode(both).alias("_m")).select(id_col, "_m.data", "_m.type")
