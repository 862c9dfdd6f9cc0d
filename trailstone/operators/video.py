"""Video probe rows: what keeps a file from being shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incompatibilities() -> Column:
    """Array of reasons over (container, pix_fmt, profile, color_space, codec, side_data array)."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    pix = low("pix_fmt")
    return F.array_compact(
        F.array(
            F.when(~low("container").contains("mp4"), "container"),
            F.when(pix.contains("10le") | pix.contains("10be") | pix.contains("p10"), "10-bit"),
            F.when(F.coalesce("profile", F.lit("")).contains("High 10"), "profile"),
            F.when(low("color_space").isin("bt2020nc", "bt2020c"), "colour space"),
            F.when(F.exists(F.coalesce("side_data", F.array().cast("array<string>")), lambda s: s.contains("DOVI")), "dolby vision"),
            F.when(low("codec") == "av1", "av1"),
        )
    )


def compatibility(probes: DataFrame) -> DataFrame:
    reasons = incompatibilities()
    return probes.select("video_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) > 0).alias("convert"))


def tally(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


#: What is read of a probe's output.
PROBE = "streams array<struct<codec_type: string, codec_name: string, pix_fmt: string, profile: string, color_space: string, side_data_list: array<struct<side_data_type: string>>>>, format struct<format_name: string>"


def parsed_probes(probes: DataFrame) -> DataFrame:
    """video_id and the columns that `compatibility` reads, from (video_id, probe), a probe's JSON; and error where it says nothing.

    The first video stream counts. A video with an error is not to be converted.
    """
    read = probes.select("video_id", F.from_json("probe", PROBE).alias("p"))
    stream = F.filter("p.streams", lambda s: s.codec_type == "video")
    found = read.select("video_id", "p", F.when(F.size(stream) > 0, stream[0]).alias("s"))
    error = F.when(F.col("p").isNull() | (F.col("p.streams").isNull() & F.col("p.format").isNull()), "JSON decode failed").when(F.col("s").isNull(), "No video stream found")
    return found.select(
        "video_id", F.col("p.format.format_name").alias("container"), "s.pix_fmt", "s.profile", "s.color_space", F.col("s.codec_name").alias("codec"),
        F.transform("s.side_data_list", lambda d: d.side_data_type).alias("side_data"), error.alias("error"),
    )


def probe_compatibility(probes: DataFrame) -> DataFrame:
    """video_id, reasons, convert and error of each probe."""
    parsed = parsed_probes(probes)
    judged = compatibility(parsed).join(parsed.select("video_id", "error"), "video_id")
    failed = F.col("error").isNotNull()
    return judged.select("video_id", F.when(failed, "").otherwise(F.col("reasons")).alias("reasons"), (F.col("convert") & ~failed).alias("convert"), "error")
