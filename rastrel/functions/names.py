"""Expressions on image, mask and channel names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.schema import ROI_DELIMITER, q


def roi_key(experiment: Column, slide: Column, acquisition: Column,
            delimiter: str = ROI_DELIMITER) -> Column:
    return F.concat_ws(delimiter, experiment, slide, acquisition)


def roi_parts(roi: Column, delimiter: str = ROI_DELIMITER) -> Column:
    return F.split(roi, "\\Q" + delimiter + "\\E")


def split_roi(df: DataFrame, column: str = "roi", delimiter: str = ROI_DELIMITER) -> DataFrame:
    """Add experiment, slide and acq columns from the image key."""
    parts = roi_parts(q(column), delimiter)
    return df.withColumns({
        "experiment": F.get(parts, F.lit(0)),
        "slide": F.get(parts, F.lit(1)),
        "acq": F.get(parts, F.lit(2)),
    })


def roi_output_name(roi: Column, delimiter: str = ROI_DELIMITER, threshold: int = 5,
                    use_filename: bool = True) -> Column:
    """Acquisition name when it is long enough to be telling, else the experiment (or the key)."""
    parts = roi_parts(roi, delimiter)
    short = F.get(parts, F.lit(0)) if use_filename else roi
    named = F.when(F.length(F.get(parts, F.lit(2))) > threshold, F.get(parts, F.lit(2)))
    return F.when(F.size(parts) == 3, named.otherwise(short)).otherwise(roi)


def pad_index(index: Column, width: int = 3) -> Column:
    """Left-pad to at least ``width`` digits; longer indices are kept whole."""
    text = F.coalesce(index.cast("string"), F.lit(""))
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def trailing_number(name: Column) -> Column:
    """Digits at the end of a name without leading zeros, NULL when there are none.

    Kept as text so that indices of any length compare equal.
    """
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(digits != "", F.regexp_replace(digits, "^0+(?=.)", ""))


def same_trailing_number(left: Column, right: Column) -> Column:
    return F.coalesce(trailing_number(left) == trailing_number(right), F.lit(False))


def parse_id_list(text: Column) -> Column:
    """Object ids typed as a comma-separated list; parts that are not integers are ignored."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    numbers = F.filter(parts, lambda p: p.rlike(r"^[+-]?\d+$"))
    return F.filter(F.transform(numbers, lambda p: p.try_cast("bigint")), lambda n: n.isNotNull())


def natural_key(name: Column) -> Column:
    """Sort key in which numbers inside a name compare by value (signed reals)."""
    piece = r"([^\d.+-]*|[.+-]*)([+-]?\d+(?:\.\d+)?|$)"
    texts = F.regexp_extract_all(name, F.lit(piece), F.lit(1))
    numbers = F.regexp_extract_all(name, F.lit(piece), F.lit(2))
    return F.zip_with(
        texts, numbers,
        lambda t, n: F.struct(t.alias("text"), n.try_cast("double").alias("number")),
    )


def object_label(object_id: Column) -> Column:
    """Object id as hover text; background shows as 'None'."""
    return F.when(object_id == 0, "None").otherwise(object_id.cast("bigint").cast("string"))


def is_hex_colour(value: Column) -> Column:
    return value.rlike("^#[a-fA-F0-9]{6}$")


def hex_to_rgb(value: Column) -> Column:
    """'#rrggbb' to a struct of three integers."""
    digits = F.regexp_replace(value, "^#+", "")
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))
