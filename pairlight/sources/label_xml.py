"""Label documents in XML to section rows."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight import vocab
from pairlight.functions import text as tx

_RAW = (
    "doc string, ok boolean, setid string, spl_version string, title string, effective_time string, "
    "manufacturer string, sections array<struct<code:string,raw:string>>"
)


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc, xml) per file; doc is the file's name without .xml, the set id under which a load looks for it.

    One file is one row, so files stay the unit of parallel work.
    """
    name = F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[xX][mM][lL])?$", 1))
    return spark.read.text(path, wholetext=True).select(name.alias("doc"), F.col("value").alias("xml"))


_TYPES = [pa.string(), pa.bool_(), *[pa.string()] * 5, pa.list_(pa.struct([("code", pa.string()), ("raw", pa.string())]))]
_ROWS = 64


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of each document; a few documents at a time are Python objects, however many a batch holds."""
    tag = lambda name: f"{{{vocab.LABEL_NAMESPACE}}}{name}"
    wanted = {code for code, _ in vocab.SECTIONS.values()}

    def attribute(node, child: str, name: str):
        hit = node.find(tag(child))
        return None if hit is None else hit.get(name)

    def one(xml: str) -> tuple:
        try:
            root = ElementTree.fromstring(xml)
        except (ElementTree.ParseError, TypeError, ValueError):
            return (False,) + (None,) * 6
        title = root.find(tag("title"))
        maker = root.find(f"{tag('author')}//{tag('representedOrganization')}/{tag('name')}")
        sections = []
        for node in root.iter(tag("section")):
            code = attribute(node, "code", "code")
            if code in wanted:
                body = node.find(tag("text"))
                sections.append((code, "" if body is None else " ".join(body.itertext())))
        return (
            True,
            attribute(root, "setId", "root"),
            attribute(root, "versionNumber", "value"),
            None if title is None else "".join(title.itertext()),
            attribute(root, "effectiveTime", "value"),
            None if maker is None else maker.text,
            [{"code": c, "raw": r} for c, r in sections],
        )

    names = ["doc", "ok", "setid", "spl_version", "title", "effective_time", "manufacturer", "sections"]
    for batch in batches:
        for k in range(0, len(batch), _ROWS):
            part = batch.slice(k, _ROWS)
            fields = zip(*(one(x) for x in part.column("xml").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([part.column("doc").to_pylist(), *fields], _TYPES, strict=True)], names=names)


def parse_labels(docs: DataFrame) -> DataFrame:
    """One row per (doc, xml): header fields, error, and an array of all target sections.

    Python only walks the tree of one document at a time; choosing among repeated
    sections, placeholder handling and defaults are column expressions. Per code
    the first occurrence with content wins, else the first.
    """
    raw = docs.select(F.col("doc").cast("string"), "xml").mapInArrow(_parse, _RAW)
    clean = F.transform("sections", lambda s: F.struct(s["code"].alias("code"), tx.squish(s["raw"]).alias("text")))
    target = F.array(*[
        F.struct(F.lit(k).alias("section_key"), F.lit(c).alias("section_code"), F.lit(n).alias("section_name"))
        for k, (c, n) in vocab.SECTIONS.items()
    ])

    def chosen(found, t):
        full = F.filter(found, lambda s: (s["code"] == t["section_code"]) & tx.meaningful(s["text"]))
        text = F.coalesce(F.get(full, F.lit(0))["text"], F.lit(""))
        return F.struct(t["section_key"], t["section_code"], t["section_name"], text.alias("text"),
                        (text != "").alias("found"))

    empty_to_null = lambda c: F.nullif(F.col(c), F.lit(""))
    return raw.select(
        "doc",
        "setid", "spl_version",
        F.when(F.col("ok"), tx.strip(F.col("title"))).alias("title"),
        "effective_time",
        tx.strip(empty_to_null("manufacturer")).alias("manufacturer"),
        F.when(F.col("ok"), tx.let(clean, lambda s: F.transform(target, lambda t: chosen(s, t)))).alias("sections"),
        F.when(~F.col("ok"), F.lit("document cannot be parsed")).alias("error"),
    )


def section_rows(parsed: DataFrame) -> DataFrame:
    """(doc, section_key, section_code, section_name, text, found, error); a broken document gives one error row."""
    return parsed.select("doc", F.explode_outer("sections").alias("s"), "error").select(
        "doc", "s.section_key", "s.section_code", "s.section_name", "s.text",
        F.coalesce("s.found", F.lit(False)).alias("found"), "error",
    )
