"""A table of processed candidates in Parquet, and JSON sinks.

The table is a folder of numbered versions; the newest complete one counts. Saving appends to it, clearing begins an empty one. A version
is cut into folders by ranges of ids, so looking up an id reads the one folder that may have it. Deleting writes the id to a small table beside
the version, which reading leaves out by an anti-join: no row is written again. ``compact`` writes a version without deleted rows. Ids go on
after deletions. One writer at a time is assumed, as with a local database.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.schema import CANONICAL_FIELDS

STORE = (
    "id bigint, candidate_id string, resume_name string, full_name string, email string, phone string, location string, "
    "years_experience double, skills_count int, overall_confidence double, sources_count int, final_profile string, "
    "projected_profile string, processed_at timestamp"
)
#: Columns of a list of candidates: all but the two records.
LISTED = ("id", "candidate_id", "resume_name", "full_name", "email", "phone", "location", "years_experience", "skills_count", "overall_confidence", "sources_count", "processed_at")


def location_text(location: Column) -> Column:
    """``city, country`` of what is there."""
    return F.coalesce(F.concat_ws(", ", F.nullif(location["city"], F.lit("")), F.nullif(location["country"], F.lit(""))), F.lit(""))


def record_json(frame: DataFrame, columns: list[str]) -> Column:
    """A record as JSON, with nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def store_rows(fused: DataFrame, projected: DataFrame, names: DataFrame | None = None, processed_at: Column | None = None) -> DataFrame:
    """Rows to save, without ids: fused records joined with their projected JSON (and resume names, by candidate_key)."""
    canonical = [c for c in fused.columns if c not in ("candidate_key", "sources_attempted", "sources_used")]
    rows = fused.join(projected.select("candidate_key", "projected"), "candidate_key", "left")
    rows = rows.join(names.select("candidate_key", "resume_name"), "candidate_key", "left") if names is not None else rows.withColumn("resume_name", F.lit(None).cast("string"))
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "candidate_id",
        "resume_name",
        or_empty(F.col("full_name")).alias("full_name"),
        or_empty(F.get("emails", 0)).alias("email"),
        or_empty(F.get("phones", 0)).alias("phone"),
        location_text(F.col("location")).alias("location"),
        F.coalesce("years_experience", F.lit(0.0)).alias("years_experience"),
        F.size(F.coalesce("skills", F.array().cast(fused.schema["skills"].dataType))).alias("skills_count"),
        "overall_confidence",
        F.col("sources_attempted").cast("int").alias("sources_count"),
        record_json(fused, canonical).alias("final_profile"),
        F.col("projected").alias("projected_profile"),
        (F.current_timestamp() if processed_at is None else processed_at).alias("processed_at"),
    )


def stats(rows: DataFrame) -> DataFrame:
    """total, avg_confidence, avg_skills, avg_experience."""
    return rows.agg(
        F.count("*").alias("total"),
        F.round(F.avg("overall_confidence"), 2).alias("avg_confidence"),
        F.round(F.avg("skills_count"), 1).alias("avg_skills"),
        F.round(F.avg("years_experience"), 1).alias("avg_experience"),
    )


def iso_utc(time: Column) -> Column:
    """A timestamp as ISO text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def latest(rows: DataFrame, limit: int = 200) -> DataFrame:
    """A page of rows without their records, newest first."""
    return rows.select(*LISTED).orderBy(F.desc("id")).limit(limit)


def lookup(rows: DataFrame, row_id: int) -> DataFrame:
    return rows.where(F.col("id") == row_id)


def decoded(rows: DataFrame) -> DataFrame:
    """Rows with their records read back from JSON; text that is no JSON is null."""
    final = ", ".join(f"{k} {kind}" for k, kind in CANONICAL_FIELDS.items())
    return rows.withColumns({"final_profile": F.from_json("final_profile", final), "projected_profile": F.try_parse_json("projected_profile")})


class CandidateStore:
    """See the module. ``ids_per_folder`` is a table's for life."""

    def __init__(self, spark: SparkSession, path: str, ids_per_folder: int = 1_000_000):
        self.spark, self.path, self.ids_per_folder = spark, path.rstrip("/"), ids_per_folder
        self.versions = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.versions.getFileSystem(spark._jsc.hadoopConfiguration())

    def _version(self) -> int:
        """The newest version; 0 if there is none."""
        if not self.files.exists(self.versions):
            return 0
        found = [str(s.getPath().getName()) for s in self.files.listStatus(self.versions)]
        done = [int(x[1:]) for x in found if x[:1] == "v" and x[1:].isdigit() and self.files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}/_SUCCESS"))]
        return max(done, default=0)

    def init(self) -> None:
        """Creates the table if it is not there."""
        if not self._version():
            self._empty()

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}")

    def _write(self, rows: DataFrame, version: int, mode: str) -> None:
        folder = F.floor((F.col("id") - 1) / self.ids_per_folder)
        columns = [c.split()[0] for c in STORE.split(", ")]
        rows.select(*columns, folder.alias("id_range")).sortWithinPartitions("id_range", "id").write.mode(mode).partitionBy("id_range").parquet(f"{self.path}/v{version}")

    def _empty(self) -> None:
        self._write(self.spark.createDataFrame([], STORE), self._version() + 1, "overwrite")

    def _written(self) -> DataFrame:
        """The version's rows, with those deleted since."""
        self.init()
        return self.spark.read.schema(STORE + ", id_range bigint").parquet(f"{self.path}/v{self._version()}")

    def _rows(self, row_id: int | None = None) -> DataFrame:
        """The rows that are there; with an id those of the folder that may have it."""
        every, version = self._written(), self._version()
        if row_id is not None:
            every = every.where((F.col("id_range") == (row_id - 1) // self.ids_per_folder) & (F.col("id") == row_id))
        every = every.drop("id_range")
        if self.files.exists(self._path(f"gone/v{version}")):
            gone = self.spark.read.schema("id bigint").parquet(f"{self.path}/gone/v{version}")
            every = every.join(gone if row_id is None else gone.where(F.col("id") == row_id), "id", "left_anti")
        return every

    def rows(self) -> DataFrame:
        return self._rows()

    def compact(self) -> None:
        """Writes the rows that are there as the next version, without what was deleted."""
        self._mark()
        self._write(self._rows().repartitionByRange("id"), self._version() + 1, "overwrite")

    def _last_id(self) -> int:
        top = self._written().agg(F.max("id")).first()[0] or 0
        marks = f"{self.path}/last_ids"
        if self.files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(marks)):
            top = max(top, self.spark.read.schema("last bigint").parquet(marks).agg(F.max("last")).first()[0] or 0)
        return top

    def save(self, rows: DataFrame) -> tuple[int, int]:
        """Appends rows of ``store_rows``; returns the first id given and the number of rows."""
        last = self._last_id()
        folder = f"{self.path}/staged"
        rows.withColumn("at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(folder)
        staged = self.spark.read.parquet(folder)
        part = F.shiftright("at", 33)
        sizes = sorted((r["p"], r["n"]) for r in staged.groupBy(part.alias("p")).agg(F.max(F.expr("at & 8589934591L") + 1).alias("n")).collect())
        starts, total = [], last
        for p, n in sizes:
            starts.append((p, total))
            total += n
        if not starts:
            return last + 1, 0
        begin = F.create_map(*[F.lit(x) for pair in starts for x in pair]) if len(starts) < 1000 else None
        if begin is None:
            offsets = self.spark.createDataFrame(starts, "p bigint, start bigint")
            numbered = staged.withColumn("p", part).join(offsets, "p").withColumn("id", F.col("start") + F.expr("at & 8589934591L") + 1)
        else:
            numbered = staged.withColumn("id", begin[part].cast("bigint") + F.expr("at & 8589934591L") + 1)
        self._write(numbered.repartitionByRange(len(starts), "id"), self._version(), "append")
        return last + 1, total - last

    def latest(self, limit: int = 200) -> DataFrame:
        """The newest rows without their records, newest first (a page)."""
        return latest(self.rows(), limit)

    def get(self, row_id: int) -> DataFrame:
        """The row with that id, if any; its records are JSON text."""
        return self._rows(row_id)

    def record(self, row_id: int) -> DataFrame:
        """The row with that id, its records read back: ``final_profile`` as a struct, ``projected_profile`` as a variant."""
        return decoded(self.get(row_id))

    def delete(self, row_id: int) -> None:
        """Takes the row out; nothing happens if there is none with that id."""
        self.init()
        self.spark.createDataFrame([(row_id,)], "id bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/gone/v{self._version()}")

    def clear(self) -> None:
        self._mark()
        self._empty()

    def _mark(self) -> None:
        """Remembers the highest id given, which a deletion may take out of the table."""
        self.spark.createDataFrame([(self._last_id(),)], "last bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/last_ids")

    def stats(self) -> DataFrame:
        return stats(self.rows())

    def export(self) -> DataFrame:
        """(id, file_name, projected_profile, canonical_name, final_profile, processed_at as ISO text in UTC) of all rows, by one scan."""
        name = lambda prefix: F.concat(F.lit(prefix), "candidate_id", F.lit(".json"))
        return self.rows().select("id", name("candidate_").alias("file_name"), "projected_profile", name("canonical_").alias("canonical_name"), "final_profile", iso_utc(F.col("processed_at")).alias("processed_at"))

    def _newest_first(self, files: int | None) -> DataFrame:
        """The projected records in as many ranges as files, those with the greatest ids first, sorted inside."""
        rows = self.export().select("id", "projected_profile")
        order = F.desc("id")
        return (rows.repartitionByRange(files, order) if files else rows.repartitionByRange(order)).sortWithinPartitions(order)

    def write_export(self, path: str, files: int | None = None) -> None:
        """All projected records that are there as JSON lines, newest first from file to file: the bulk download of a table of any size."""
        self._newest_first(files).where("projected_profile is not null").select(F.col("projected_profile").alias("value")).write.mode("overwrite").text(path)

    def write_array(self, path: str, files: int | None = None) -> None:
        """All projected records as one JSON list, newest first: the files in the order of their names, put together. A missing one is null."""
        ends = self.rows().agg(F.max("id").alias("first"), F.min("id").alias("last")).first()
        if ends["first"] is None:
            self.spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
            return
        record = F.coalesce("projected_profile", F.lit("null"))
        line = F.concat(F.when(F.col("id") == ends["first"], "[").otherwise(","), record, F.when(F.col("id") == ends["last"], "]").otherwise(""))
        self._newest_first(files).select(line.alias("value")).write.mode("overwrite").text(path)


def json_array(page: DataFrame, column: str, order: str = "id", limit: int = 200) -> DataFrame:
    """One row with a JSON array of the texts, newest first: the download of one page, of at most ``limit`` rows.

    A whole table goes to files instead, see ``CandidateStore.write_export``.
    """
    newest = page.select(order, column).orderBy(F.desc(order)).limit(limit)
    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, column)), asc=False), lambda r: r[column])
    return newest.agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("document"))
