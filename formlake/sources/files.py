"""Reading uploads, page images, JSON parameters and labelled samples; writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024
IMAGE_ENDS = r"(?i)\.(png|jpe?g|gif|bmp|tiff?|webp)$"
IMAGE_COLUMNS = ["image", "img", "image_path", "image_bytes"]
TRUTH_COLUMNS = ["text", "label", "ground_truth", "transcription", "text_ground_truth"]


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def upload_error(length: Column, limit: int = MAX_BYTES) -> Column:
    """empty, too_large or null; a limit of 0 switches the latter off."""
    out = F.when(F.coalesce(length, F.lit(0)) == 0, "empty")
    return out.when(length > limit, "too_large") if limit else out


def file_kind(content: Column, name: Column, mime: Column | None = None) -> Column:
    """pdf, png, jpeg, gif, bmp, image (by name) or null. Any sign of a PDF wins; then leading bytes win over the name."""
    head = F.hex(F.substring(content, 1, 4))
    type_ = F.coalesce(mime, F.lit("")) if mime is not None else F.lit("")
    pdf = F.lower(name).endswith(".pdf") | F.lower(type_).contains("pdf") | head.startswith("25504446")
    return (
        F.when(pdf, "pdf").when(head == "89504E47", "png").when(head.startswith("FFD8FF"), "jpeg").when(head == "47494638", "gif").when(head.startswith("424D"), "bmp")
        .when(name.rlike(IMAGE_ENDS), "image")
    )


def accepted(files: DataFrame, limit: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files with their kind, and rejected ones with the reason."""
    judged = files.withColumn("kind", file_kind(F.col("content"), F.col("path"))).withColumn("reason", F.coalesce(upload_error(F.col("length"), limit), F.when(F.col("kind").isNull(), "unsupported")))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").drop("content")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Page images in Spark's image struct; a file that is no image has height -1 and no data, see `readable`."""
    return spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path)


def readable(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The images that could be read, and path and reason of the others."""
    good = F.col("image.height") > 0
    return found.where(good), found.where(~F.coalesce(good, F.lit(False))).select(F.col("image.origin").alias("path"), F.lit("not an image").alias("reason"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, value."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")


def stored_name(name: Column) -> Column:
    """A fresh name for an upload: a random id, then the name with underscores for blanks."""
    return F.concat_ws("_", F.replace(F.uuid(), F.lit("-"), F.lit("")), F.regexp_replace(name, " ", "_"))


def first_column(df: DataFrame, names: list[str]) -> str | None:
    """The first of `names` that df has."""
    return next((n for n in names if n in df.columns), None)


def samples(df: DataFrame) -> DataFrame:
    """sample_id, image and ground_truth from a labelled data set's own column names."""
    image, truth = first_column(df, IMAGE_COLUMNS), first_column(df, TRUTH_COLUMNS)
    return df.select(
        F.monotonically_increasing_id().alias("sample_id"), (F.col(image) if image else F.lit(None).cast("string")).alias("image"),
        (F.col(truth).cast("string") if truth else F.lit(None).cast("string")).alias("ground_truth"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
