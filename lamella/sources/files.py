"""Files as rows: scanning, expanding archives, telling kinds apart, decoding, and a store keyed by content."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of one archive: members, bytes of a member, bytes of all.
MEMBERS, MEMBER_BYTES, ALL_BYTES = 256, 64 << 20, 256 << 20


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path (relative), content: every file of a folder, or the one file; hidden files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = files.withColumn("name", F.regexp_replace("path", r"^.*/", "")).filter(~F.startswith("name", F.lit(".")))
    base = path.rstrip("/").split("://")[-1]
    return files.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + _quoted(base) + "/", "").alias("path"), "content")


def _quoted(text: str) -> str:
    import re

    return "/" + re.escape(text.lstrip("/"))


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """The files of a zip. Sizes are enforced while unpacking; links, empty members, climbing names and archives inside are left out."""
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for count, info in enumerate(x for x in archive.infolist() if not x.is_dir()):
            if count >= MEMBERS:
                return
            parts = info.filename.replace("\\", "/").split("/")
            if (info.external_attr >> 16) & 0o170000 == 0o120000 or ".." in parts or info.filename.startswith("/") or parts[-1].startswith("."):
                continue
            with archive.open(info) as f:
                content = f.read(min(MEMBER_BYTES, ALL_BYTES - total) + 1)
            if len(content) > MEMBER_BYTES or total + len(content) > ALL_BYTES:
                raise ValueError(f"{info.filename} unpacks to more than is allowed")
            total += len(content)
            if content and content[:4] != b"PK\x03\x04":
                yield "/".join(parts), content


def expand(files: DataFrame) -> DataFrame:
    """files with each zip replaced by its members (path: the zip's, a slash, the member's); problem: why one was not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if content[:4] != b"PK\x03\x04":
                    out.append((path, content, None))
                    continue
                try:
                    out += [(f"{path}/{name}", data, None) for name, data in members(content)]
                except (ValueError, zipfile.BadZipFile, RuntimeError) as e:
                    out.append((path, b"", str(e)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.string()), strict=True)], names=["path", "content", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, problem string")


def decoded(content: Column) -> Column:
    """UTF-8 text (a byte order mark taken off), or Windows-1252 where it isn't UTF-8."""
    high = {chr(b): bytes([b]).decode("cp1252", errors="replace") for b in range(0x80, 0xA0)}  # where Latin-1 has control characters
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(high), "".join(high.values()))
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), latin), "^\ufeff", "")


def container(content: Column) -> Column:
    """zip, gzip, lzw, tar, xml or null, by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    starts = lambda x: F.startswith(head, F.lit(x))
    return (
        F.when(starts("504B0304"), "zip").when(starts("1F8B"), "gzip").when(starts("1F9D"), "lzw").when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar")
        .when(starts("3C3F786D6C") | starts("EFBBBF3C3F786D"), "xml")
    )


def sniffed(content: Column) -> Column:
    """step, glb, stl or null: what a model file is by its first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(F.startswith(head, F.lit("49534F2D31303330332D3231")), "step").when(F.startswith(head, F.lit("676C5446")), "glb").when(F.startswith(head, F.lit("736F6C6964")), "stl")


def classified(files: DataFrame) -> DataFrame:
    """files (path, content) with kind, side and layer: a plot's own attribute, then drill content, then the name, then tables by their heads."""
    text = F.substring(decoded(F.col("content")), 1, 4000)
    name = F.lower(F.regexp_replace("path", r"^.*/", ""))
    function = F.regexp_extract(text, r"TF\.FileFunction,([^*\r\n]+)", 1)
    what, first, second = F.lower(F.split(function, ",")[0]), F.get(F.split(function, ","), F.lit(1)), F.get(F.split(function, ","), F.lit(2))
    by_attribute = (
        F.when(what == "copper", "copper").when(what == "soldermask", "mask").when(what == "paste", "paste").when(what == "legend", "silkscreen").when(what == "profile", "outline")
        .when(what.isin("plated", "nonplated", "mixedplating"), "drill")
    )
    by_name = (
        F.when(name.rlike(r"\.gbrjob$"), "job").when(name.rlike(r"\.(drl|xln|exc|txt)$") & F.trim(text).rlike("^M48"), "drill")
        .when(name.rlike(r"edge[._]?cuts|outline|profile|\.gm1$|\.gko$"), "outline").when(name.rlike(r"mask|\.gt?[tb]s$"), "mask").when(name.rlike(r"paste|\.g[tb]p$"), "paste")
        .when(name.rlike(r"silk|legend|\.g[tb]o$"), "silkscreen").when(name.rlike(r"[._-]cu\b|copper|\.g[tb]l$|\.g\d+$"), "copper")
    )
    head = F.lower(F.substring(text, 1, 2000))
    by_head = F.when(head.rlike(r"(pos|mid|center)[ _-]?x") & head.rlike(r"\bref|designator"), "placement").when(head.rlike(r"reference|designator|refdes") & head.rlike(r"value|footprint|mpn|comment"), "bom")
    kind = F.when(function != "", by_attribute)
    kind = F.coalesce(kind, F.when(F.trim(text).rlike("^M48"), "drill"), by_name, F.when(name.rlike(r"\.(csv|pos|txt|tsv)$"), by_head), F.lit("other"))
    bottom = (F.coalesce(second, first) == "Bot") | (first == "Bot") | name.rlike(r"[._-]b[._](cu|mask|paste|silks)|bottom|\.gb[lspo]$")
    top = (F.coalesce(second, first) == "Top") | (first == "Top") | name.rlike(r"[._-]f[._](cu|mask|paste|silks)|top|\.gt[lspo]$")
    layer = F.coalesce(F.regexp_extract(function, r"^Copper,L(\d+)", 1).try_cast("int"), F.when(name.rlike(r"in\d+[._]cu"), F.regexp_extract(name, r"in(\d+)[._]cu", 1).try_cast("int") + 1))
    return files.select("path", kind.alias("kind"), F.when(bottom, "bottom").when(top, "top").alias("side"), F.when(kind == "copper", layer).alias("layer"), F.sha2("content", 256).alias("sha256"))


class Store:
    """Results by the hash of what they came from: what is there isn't made again, and is never overwritten."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(conf).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def missing(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.join(self.read().select(key), key, "left_anti")

    def add(self, rows: DataFrame, key: str) -> None:
        self.missing(rows.dropDuplicates([key]), key).write.mode("append").parquet(self.path)
