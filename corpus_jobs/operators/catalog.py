"""The catalogue of documents: change detection, duplicates, removal, stored tables, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import contains_any
from ..ranges import row_numbers, running
from .retrieval import first_of

# Fixed values of the service.
PLACEHOLDERS = ["ocr processing complete", "[image:", "visual content"]
IMAGE_TYPES = ["image", "png", "jpg", "jpeg", "webp"]


def changes(listing: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """listing(file_path, filename, file_hash, ..., optional target_id) with document_id, created_at and change.

    A file is known by its given id, else by its path, else by its bare name standing as a path. It is unchanged if its
    hash is the catalogue's and its status is indexed; a changed one keeps its id and creation time; a new one has the
    given id or one made from its path.
    """
    known = catalog.select("id", "file_path", "file_hash", "status", "created_at")
    rows = listing if "target_id" in listing.columns else listing.withColumn("target_id", F.lit(None).cast("string"))

    def found(left: DataFrame, on: str, to: str, name: str) -> DataFrame:
        one = first_of(known, [to], ["id"])
        return left.join(one.select(F.col(to).alias(on), F.struct("id", "file_hash", "status", "created_at").alias(name)), on, "left")

    for on, to, name in (("target_id", "id", "_by_id"), ("file_path", "file_path", "_by_path"), ("filename", "file_path", "_by_name")):
        rows = found(rows, on, to, name)
    k = F.coalesce("_by_id", "_by_path", "_by_name")
    same = (k.getField("file_hash") == F.col("file_hash")) & (k.getField("status") == "indexed") & F.lit(not force)
    change = F.when(k.isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    new_id = F.substring(F.sha2(F.col("file_path"), 256), 1, 16)
    return rows.select(*listing.columns, F.coalesce(k.getField("id"), "target_id", new_id).alias("document_id"), k.getField("created_at").alias("created_at"), change.alias("change"))


def duplicates(catalog: DataFrame) -> DataFrame:
    """(file_hash, n, first_id) of contents that several documents have; counted before the shuffle."""
    return catalog.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def same_content(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """listing with the id of a catalogue document of the same hash, the smallest one; null where there is none."""
    known = catalog.groupBy("file_hash").agg(F.min("id").alias("same_as"))
    return listing.join(known, "file_hash", "left")


def without(ids: DataFrame, **tables: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Tables (frame, key column) without the rows of the given document ids. Spark broadcasts the ids if they are few."""
    ids = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    return {name: t.join(ids, F.col(key) == F.col("_gone"), "left_anti") for name, (t, key) in tables.items()}


def is_broken_image_text(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), PLACEHOLDERS)


def images_to_reprocess(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Image documents that have no chunk or any placeholder chunk."""
    images = catalog.filter(F.lower("file_type").isin(IMAGE_TYPES))
    broken = chunks.groupBy("document_id").agg(F.bool_or(is_broken_image_text(F.col("text"))).alias("broken"))
    joined = images.join(broken, images["id"] == broken["document_id"], "left")
    return joined.filter(F.coalesce("broken", F.lit(True))).select(*[images[c] for c in images.columns])


def stale_previews(catalog: DataFrame, manifests: DataFrame) -> DataFrame:
    """Documents without a ready manifest of the same hash."""
    ready = manifests.filter("status = 'ready'").select(F.col("document_id").alias("id"), "file_hash").distinct()
    return catalog.join(ready, ["id", "file_hash"], "left_anti").select(catalog.columns)


def newest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("created_at"), "id")


def without_nul(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.translate(F.col(f.name), "\0", "") for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def upserted(old: DataFrame, new: DataFrame, key: str, order: list | None = None) -> DataFrame:
    """old with its rows replaced by new ones of the same key; of several new ones the last by the order stays."""
    new = without_nul(new)
    if order:
        new = first_of(new, [key], [F.desc(c) for c in order])
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def store(spark: SparkSession, old_path: str | None, new: DataFrame, path: str, key: str, order: list | None = None) -> None:
    """Writes the table at old_path with new rows put in to a new path; a table is never overwritten while it is read."""
    rows = upserted(spark.read.schema(new.schema).parquet(old_path), new, key, order) if old_path else without_nul(new if not order else first_of(new, [key], [F.desc(c) for c in order]))
    rows.write.parquet(path)


def numbered_names(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """uploads(filename, seq) with dest, a name that neither exists nor another upload has: stem_1.ext, stem_2.ext, ...

    Within one name, uploads take the free numbers in order; number 0 is the bare name. Names that uploads bring along
    count as taken for other stems, so a file called stem_1.ext keeps its name and a copy of stem.ext takes the next.
    Numbers are found over ranges of uploads, so a name that most of them have is no long task.
    """
    suffix = F.regexp_extract("filename", r"(?<=[^./])\.[^./]+$", 0)
    rows = uploads.withColumns({"_ext": suffix, "_stem": F.expr("substring(filename, 1, length(filename) - length(regexp_extract(filename, '(?<=[^./])\\\\.[^./]+$', 0)))")})
    rows = row_numbers(rows, "filename", ["seq"], "_place").withColumn("_place", F.col("_place") - 1)
    ext = F.regexp_extract("name", r"(?<=[^./])\.[^./]+$", 0)
    brought = rows.select(F.col("filename").alias("name"), F.lit(1).alias("least"))
    taken = existing.select(F.col("filename").alias("name"), F.lit(0).alias("least")).unionByName(brought).groupBy("name").agg(F.min("least").alias("least"))
    forms = taken.withColumn("_ext", ext).withColumn("_base", F.expr("substring(name, 1, length(name) - length(_ext))"))
    forms = forms.select("least", F.explode(F.array(F.struct(F.col("name").alias("of"), F.lit(0).cast("long").alias("no")), F.struct(F.concat(F.regexp_extract("_base", r"^(.*)_[1-9][0-9]*$", 1), "_ext").alias("of"), F.regexp_extract("_base", r"_([1-9][0-9]*)$", 1).try_cast("long").alias("no")))).alias("x"))
    used = forms.select("x.of", "x.no", "least").filter("of <> '' and no >= least").select("of", "no").distinct()
    need = rows.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    used = used.join(need, F.col("of") == F.col("filename")).select("filename", "no")
    # the p-th free number is p plus how many used ones have at most p free ones below them: uploads by place and used
    # numbers by the free ones below them stand in one order, and a running count gives the sum
    below = F.col("no") - (F.col("_rank") - 1)
    marks = row_numbers(used, "filename", ["no"], "_rank").select("filename", below.cast("long").alias("_place"), F.lit(1).alias("_used"))
    both = rows.withColumns({"_place": F.col("_place").cast("long"), "_used": F.lit(0)}).unionByName(marks, allowMissingColumns=True)
    shifts = running(both, "filename", ["_place", F.desc("_used")], F.col("_used"), "_shift").filter("_used = 0")
    number = F.col("_place") + F.col("_shift")
    dest = F.when(number == 0, F.col("filename")).otherwise(F.concat("_stem", F.lit("_"), number.cast("string"), "_ext"))
    return shifts.select(*uploads.columns, dest.alias("dest"))
