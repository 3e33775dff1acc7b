"""Scans: JSON lines, folders of JSON, paged REST answers, XML records, STIX bundles, Parquet."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, path: str | list[str], schema: str, keep_bad: bool = False) -> DataFrame:
    """JSON lines, blank lines skipped; ``keep_bad`` adds the text of malformed ones.  Gzip files aren't split: repartition after."""
    if not keep_bad:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def last_wins(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), ordinal).alias("_r")).select(key, "_r.*")


def json_folder(spark: SparkSession, path: str, glob: str, schema: str) -> DataFrame:
    """One JSON document for each file, recursively, with file path and the text of malformed ones."""
    d = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return d.withColumn("file_path", F.col("_metadata.file_path"))


def malformed(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("files"), F.count(CORRUPT).alias("malformed"))


class PagePartition(InputPartition):
    def __init__(self, start: int):
        super().__init__(start)
        self.start = start


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.total, self.per = options["url"], int(options["total"]), int(options.get("per_page", 2000))

    def partitions(self) -> list[PagePartition]:
        return [PagePartition(i) for i in range(0, self.total, self.per)]

    def read(self, partition: PagePartition) -> Iterator[tuple]:
        with urlopen(self.url.format(start=partition.start, size=self.per), timeout=120) as r:
            yield partition.start, r.read().decode()


class PagedSource(DataSource):
    """``spark.read.format("paged_json")``: a page of a REST API for each partition, as (start, body).

    Options: url with {start} and {size}, total, per_page.  Land the pages, then
    read them as a folder; a lost task fetches its page again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "start long, body string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def complete(pages: DataFrame, total: int, per_page: int) -> DataFrame:
    """Refuses a snapshot with fewer pages than its total asks for."""
    need = -(-total // per_page)
    got = pages.select("start").distinct().count()
    if got < need:
        raise ValueError(f"{got} of {need} pages are there")
    return pages


def up_to(df: DataFrame, modified: str, snapshot: str) -> DataFrame:
    """Rows not modified after the snapshot (19 characters compared); rows without a time stay."""
    return df.where(F.coalesce(F.substring(modified, 1, 19), F.lit("")) <= snapshot[:19])


def element_dict(e: ET.Element):
    """An XML element as a dict: attributes, repeated children as lists, text and tails under their own names."""
    local = lambda t: t.rpartition("}")[2]
    out: dict = {}
    if e.attrib:
        out["@attributes"] = {local(k): v for k, v in e.attrib.items()}
    tails = []
    for c in e:
        k, v = local(c.tag), element_dict(c)
        if k in out:
            out[k] = [*out[k], v] if isinstance(out[k], list) else [out[k], v]
        else:
            out[k] = v
        if c.tail and c.tail.strip():
            tails.append(c.tail.strip())
    text = (e.text or "").strip()
    if not out:
        return text
    if text:
        out["#text"] = text
    if tails:
        out["#tails"] = tails
    return out


def xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """A row for each element ``tag``: its structural dict as JSON text.  Splits large files by the row tag."""
    raw = spark.read.format("text").option("wholetext", True).load(path)
    found = raw.select(F.explode(F.regexp_extract_all("value", F.lit(f"(?s)<{tag}[ >].*?</{tag}>"), F.lit(0))).alias("xml"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(element_dict(ET.fromstring(x)), sort_keys=True, ensure_ascii=False) for x in b.column(0).to_pylist()], pa.string())], ["content"])

    return found.mapInArrow(run, "content string")


def flatten_text(value) -> str:
    """All text of a structural dict in order; an element with its own text gives that alone."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for v in value if (t := flatten_text(v)))
    if isinstance(value, dict):
        if "#text" in value:
            return " ".join([value["#text"], *value.get("#tails", [])])
        return "\n".join(t for k, v in value.items() if not k.startswith("@") and (t := flatten_text(v)))
    return ""


def stix_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects of STIX bundles: content_type ``stix_<type>``, id and the object's JSON text."""
    d = spark.read.text(path, wholetext=True).where(F.get_json_object("value", "$.type") == "bundle")
    o = d.select(F.explode(F.from_json(F.get_json_object("value", "$.objects"), "array<string>")).alias("content"))
    return o.select(F.concat(F.lit("stix_"), F.get_json_object("content", "$.type")).alias("content_type"), F.get_json_object("content", "$.id").alias("id"), "content")


def verified_files(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """path, sha256 and ``fine`` of files, against recorded digests."""
    f = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
    r = recorded.select("path", F.col("sha256").alias("recorded"))
    return f.join(r, "path", "left").withColumn("fine", F.col("sha256").eqNullSafe(F.col("recorded")))


def within_bound(df: DataFrame, most: int = 20 << 30) -> None:
    """Refuses a source whose files are larger than ``most`` bytes together."""
    n = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct().agg(F.sum("s")).first()[0] or 0
    if n > most:
        raise ValueError(f"{n} bytes; at most {most} are read")


def lock_lines(spark: SparkSession, path: str) -> DataFrame:
    """name and version of ``name==version`` lines; comments and the rest are skipped."""
    v = F.trim(F.split_part("value", F.lit("#"), F.lit(1)))
    return spark.read.text(path).select(v.alias("v")).where(F.col("v").contains("==")).select(F.split_part("v", F.lit("=="), F.lit(1)).alias("name"), F.split_part("v", F.lit("=="), F.lit(2)).alias("version"))
