"""Patient documents: one JSON line per patient."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from joeira.functions.dates import format_date
from joeira.functions.ids import year_prefix
from joeira.sinks.files import Store

# Order of the fields in a document.
FIELDS = ("processo", "nome", "data_ent", "data_alta", "destino", "sexo", "data_nasc", "origem")
DOCUMENT = "_id string, processo bigint, nome string, data_ent string, data_alta string, destino string, sexo string, data_nasc string, origem string"
MANIFEST = "_documents.json"
DATES = ("data_ent", "data_alta", "data_nasc")


def document_columns() -> list:
    return [F.col("ID").alias("_id")] + [
        (format_date(F.col(c)) if c in DATES else F.col(c)).alias(c) for c in FIELDS
    ]


def to_json_text(pretty: bool = False):
    """The document as JSON text: nulls kept, dates as dd-mm-yyyy."""
    options = {"ignoreNullFields": "false"}
    if pretty:
        options["pretty"] = "true"
    return F.to_json(F.struct(*document_columns()), options)


def latest_per_id(patients: DataFrame) -> DataFrame:
    """Last row in file order for every ID.

    Spark cuts each ID down to one row per task before the shuffle, so an ID
    with very many rows does not travel whole.
    """
    newest = W.partitionBy("ID").orderBy(F.col("row_idx").desc())
    return patients.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


@dataclass
class Manifest:
    """Which folders hold the current documents: one for each bucket of IDs (and year) that has any."""

    buckets: int
    by_year: bool
    folders: dict[str, str]  # of a bucket, and of the run that wrote it
    text: str | None = None  # as read

    @classmethod
    def read(cls, store: Store, out_dir: str) -> Manifest | None:
        text = store.read(f"{out_dir}/{MANIFEST}")
        return None if text is None else cls(**json.loads(text), text=text)

    def paths(self, out_dir: str, only: set[str] | None = None) -> list[str]:
        return [f"{out_dir}/{folder}/{run}" for folder, run in sorted(self.folders.items()) if only is None or folder in only]

    def write(self, store: Store, out_dir: str) -> None:
        store.swap_file(f"{out_dir}/{MANIFEST}", json.dumps({"buckets": self.buckets, "by_year": self.by_year, "folders": self.folders}, sort_keys=True))


def read_documents(spark: SparkSession, out_dir: str) -> DataFrame:
    """The current documents in ``out_dir``, ``_id`` and the fields, as the last whole run left them."""
    out_dir = out_dir.rstrip("/")
    manifest = Manifest.read(Store(spark, out_dir), out_dir)
    if manifest is None or not manifest.folders:
        return spark.createDataFrame([], DOCUMENT)
    return spark.read.schema(DOCUMENT).json(manifest.paths(out_dir))


def _placed(docs: DataFrame, buckets: int, by_year: bool) -> DataFrame:
    place = [F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int").alias("bucket")]
    return docs.select("*", *([year_prefix(F.col("_id")).alias("year")] if by_year else []), *place)


def write_documents(patients: DataFrame, out_dir: str, by_year: bool = False, buckets: int = 16) -> str:
    """Put the latest row per ID into the documents in ``out_dir``, as ASCII JSON lines.

    A document replaces the one of the same ID and leaves all others, of this and of earlier runs.  Documents lie in ``buckets``
    by a hash of their ID, and by year if so wanted; both are settled by the first run (about a million IDs to a bucket is a good size).
    A run reads and writes again only the buckets that its IDs fall into, beside the old ones.  One swap of the manifest makes the
    new ones current; until then, and if the run is cut off, the former state is.  Two runs at once: the second to finish fails.
    """
    spark, out_dir = patients.sparkSession, out_dir.rstrip("/")
    store = Store(spark, out_dir)
    before = Manifest.read(store, out_dir) or Manifest(buckets, by_year, {})
    if before.by_year != by_year:
        raise ValueError(f"the documents in {out_dir!r} are{'' if before.by_year else ' not'} kept by year")
    place = [*(["year"] if by_year else []), "bucket"]
    new = _placed(latest_per_id(patients).select(*document_columns()), before.buckets, by_year)
    docs = new.withColumn("_new", F.lit(1))
    if before.folders:
        # Which buckets are met is known from the IDs alone: at most ``buckets`` a year.
        met = {_folder(store, r.asDict(), place) for r in new.select(*place).distinct().collect()}
        paths = before.paths(out_dir, met)
        if paths:
            old = _placed(spark.read.schema(DOCUMENT).json(paths), before.buckets, by_year)
            docs = docs.unionByName(old.withColumn("_new", F.lit(0)))
    # A bucket is one task, which also sees the old and the new document of an ID side by side.
    first = W.partitionBy(*place, "_id").orderBy(F.desc("_new"))
    merged = docs.repartition(*place).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_new")
    run = f"run={uuid.uuid4().hex}"
    try:
        (
            merged.withColumn("run", F.lit(run.removeprefix("run="))).write.mode("append").partitionBy(*place, "run")
            .option("ignoreNullFields", "false").option("writeNonAsciiCharacterAsCodePoint", "true").json(out_dir)
        )
        depth = len(store.qualified(out_dir)) + 1
        written = {p[depth:].rpartition("/")[0]: run for p in store.matches(f"{out_dir}{'/*' * len(place)}/{run}")}
        now = Manifest.read(store, out_dir)
        if (now.text if now else None) != before.text:
            raise RuntimeError(f"another run has changed the documents in {out_dir!r}")
        after = Manifest(before.buckets, by_year, {**before.folders, **written})
        after.write(store, out_dir)
    except BaseException:
        for left in store.matches(f"{out_dir}{'/*' * len(place)}/{run}"):
            store.delete(left)
        raise
    current = {store.qualified(p) for p in after.paths(out_dir)}
    for path in store.matches(f"{out_dir}{'/*' * len(place)}/run=*"):
        if path not in current:
            store.delete(path)
    return out_dir


def _folder(store: Store, values: dict, place: list[str]) -> str:
    """The folder that Spark writes these values of the partition columns to."""
    name = store.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join(name(c, None if values[c] is None else str(values[c])) for c in place)
