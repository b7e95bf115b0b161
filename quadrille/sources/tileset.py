"""Tileset documents: files, archives' root documents, and which source a specification names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import uris as U

#: A live photorealistic root has this in its path.
LIVE = "/3dtiles/root.json"


def parse(texts: DataFrame, column: str = "text") -> DataFrame:
    """``texts`` with doc, the parsed document, and error where it is no tileset; unknown members are ignored."""
    rows = texts.withColumn("doc", F.expr(f"try_parse_json({column})"))
    need = "CASE WHEN doc is null THEN 'not JSON' " + " ".join(f"WHEN try_variant_get(doc, '$.{at}', '{kind}') is null THEN 'no {at}'" for at, kind in (("geometricError", "double"), ("root", "variant"), ("asset.version", "string"), ("root.geometricError", "double"), ("root.boundingVolume", "variant"))) + " END"
    return rows.withColumn("error", F.expr(need)).withColumn("doc", F.expr("if(error is null, doc, null)"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file, folder or glob: path, doc, error."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return parse(files).drop("text")


def dispatched(specs: DataFrame) -> DataFrame:
    """``specs`` with source: archive, live or exploded, and base, what entries' URIs are relative to."""
    kind = f"CASE WHEN {U.is_archive('spec')} THEN 'archive' WHEN contains({U.without_query('spec')}, '{LIVE}') THEN 'live' ELSE 'exploded' END"
    return specs.withColumn("source", F.expr(kind)).withColumn("base", F.expr(f"if(source = 'archive', spec, coalesce(rtrim('/', {U.directory('spec')}), ''))"))


def framed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc, live) with frame: ecef for live and georeferenced sets, else local."""
    from quadrille.functions import geodesy as G

    get = lambda at, kind: f"try_variant_get(doc, '$.root.{at}', '{kind}')"
    center = f"coalesce(slice({get('boundingVolume.box', 'array<double>')}, 1, 3), slice({get('boundingVolume.sphere', 'array<double>')}, 1, 3))"
    region = f"if({get('boundingVolume.box', 'variant')} is null AND {get('boundingVolume.sphere', 'variant')} is null, {get('boundingVolume.region', 'array<double>')}, null)"
    return docs.withColumn("frame", F.expr(f"if(live OR {G.georeferenced(region, center, get('transform', 'array<double>'))}, 'ecef', 'local')"))
