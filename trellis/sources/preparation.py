"""Preparation of public data sets: nested claims, map nodes and tags, archives, shapes, points in polygons."""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.plans.scope import quoted

_SNAK = "struct<property:string,datatype:string,snaktype:string,hash:string,datavalue:struct<value:string>>"
_CLAIMS = f"map<string,array<struct<id:string,rank:string,mainsnak:{_SNAK},qualifiers:map<string,array<{_SNAK}>>>>>"


def flatten_claims(items: DataFrame, item_col: str = "id", claims_col: str = "claims") -> DataFrame:
    """A row for each main snak and each qualifier of the claims, a JSON text of {property: [claim]}.

    A value that is an object gives its id, amount or time, else its JSON; without a value the text is empty.
    """
    claims = items.select(quoted(item_col).alias("item_id"), F.explode(F.from_json(quoted(claims_col), _CLAIMS)).alias("claim_property", "of"))
    claims = claims.select("item_id", "claim_property", F.explode("of").alias("c"))
    main = F.when(F.col("c.mainsnak").isNotNull(), F.array(F.struct(F.lit("mainsnak").alias("type"), F.col("c.mainsnak").alias("s"))))
    others = F.transform(F.flatten(F.map_values("c.qualifiers")), lambda s: F.struct(F.lit("qualifier").alias("type"), s.alias("s")))
    none = F.array().cast(f"array<struct<type:string,s:{_SNAK}>>")
    rows = claims.select("*", F.explode(F.concat(F.coalesce(main, none), F.coalesce(others, none))).alias("snak"))
    value, snak = F.col("snak.s.datavalue.value"), F.col("snak.s")
    fields = F.when(value.startswith("{"), F.from_json(value, "map<string,string>"))
    text = F.coalesce(F.try_element_at(fields, F.lit("id")), F.try_element_at(fields, F.lit("amount")), F.try_element_at(fields, F.lit("time")), value, F.lit(""))
    or_ = lambda c, default: F.coalesce(c, F.lit(default))
    return rows.select(
        "item_id", "claim_property", or_(F.col("c.id"), "").alias("claim_id"), or_(F.col("c.rank"), "normal").alias("rank"),
        or_(snak["property"], "").alias("snak_property"), text.alias("snak_value"), or_(snak["datatype"], "").alias("snak_datatype"),
        or_(snak["snaktype"], "value").alias("snak_snaktype"), or_(snak["hash"], "").alias("snak_hash"), F.col("snak.type").alias("snak_type"),
    )


def geolocated(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Of lines of JSON entities those with a latitude: id, English labels, descriptions and aliases, claims, as JSON texts.

    Brackets of an array around the lines and commas after them don't matter; lines that are no JSON are left out.
    """
    text = F.regexp_replace(F.trim(quoted(text_col)), ",$", "")
    rows = lines.where(quoted(text_col).contains("latitude")).select(text.alias("t")).where(F.try_parse_json("t").isNotNull())
    english = [F.get_json_object("t", f"$.{c}.en").alias(c) for c in ("labels", "descriptions", "aliases")]
    return rows.select(F.get_json_object("t", "$.id").alias("id"), *english, F.get_json_object("t", "$.claims").alias("claims"))


def tagged_nodes(nodes: DataFrame, trivial: list[str], tags_col: str = "tags") -> DataFrame:
    """Nodes with a tag outside the trivial families (the part of a key before its first colon); all tags as base64 JSON."""
    families = F.transform(F.map_keys(quoted(tags_col)), lambda k: F.split(k, ":", 2)[0])
    kept = nodes.where(F.size(F.array_except(families, F.array(*[F.lit(t) for t in trivial]).cast("array<string>"))) > 0)
    encoded = F.regexp_replace(F.base64(F.encode(F.to_json(quoted(tags_col)), "UTF-8")), "\r\n", "")
    return kept.withColumn("encoded_tags", encoded).drop(tags_col)


def tag_tally(rows: DataFrame, column: str = "encoded_tags") -> DataFrame:
    """(key, value, count) over base64 JSON maps."""
    tags = F.from_json(F.decode(F.unbase64(quoted(column)), "UTF-8"), "map<string,string>")
    return rows.select(F.explode(tags).alias("key", "value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("count"))


def by_either(rows: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Rows where one of the code columns begins with the prefix."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(quoted(c).cast("string").startswith(prefix), F.lit(False))
    return rows.where(hit)


def zip_lines(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(archive, member, number, line) of the members of zip archives whose name matches; an archive is a task's."""

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in sorted(n for n in z.namelist() if fnmatch.fnmatch(n, pattern)):
                        rows: list[tuple] = []
                        with z.open(member) as f:
                            for number, line in enumerate(io.TextIOWrapper(f, "utf-8", newline="\n")):
                                rows.append((archive, member, number, line.rstrip("\r\n")))
                                if len(rows) == 4096:
                                    yield _batch(rows)
                                    rows = []
                        yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["archive", "member", "number", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, member string, number long, line string")


def zipped_csv(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv") -> DataFrame:
    """Rows of all CSV members, appended; each member's first line is its header."""
    lines = zip_lines(spark, path, pattern).where("number > 0")
    return lines.select(F.from_csv("line", schema).alias("r")).select("r.*")


# shapes


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, rings) of the points and polygons of shapefiles, all files appended: a point is a ring of one place.

    ``rings`` is array<array<struct<x, y>>>; records of other types and null shapes have none.
    """

    def shapes(data: bytes):
        at = 100
        while at + 8 <= len(data):
            number, words = struct.unpack_from(">ii", data, at)
            (kind,) = struct.unpack_from("<i", data, at + 8)
            rings = None
            if kind in (1, 11, 21):
                rings = [[struct.unpack_from("<2d", data, at + 12)]]
            elif kind in (3, 5, 13, 15, 23, 25):
                parts, places = struct.unpack_from("<2i", data, at + 44)
                begins = [*struct.unpack_from(f"<{parts}i", data, at + 52), places]
                flat = struct.unpack_from(f"<{2 * places}d", data, at + 52 + 4 * parts)
                rings = [[(flat[2 * k], flat[2 * k + 1]) for k in range(a, b)] for a, b in zip(begins, begins[1:], strict=False)]
            yield number, rings
            at += 8 + 2 * words

    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(shapes(content.as_py()))
                rings = [None if r is None else [[{"x": x, "y": y} for x, y in ring] for ring in r] for _, r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), pa.array(rings, kind)], ["file", "number", "rings"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.shp$", 1).alias("file"), "content")
    return files.mapInArrow(run, "file string, number int, rings array<array<struct<x:double,y:double>>>")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, attributes) of the dBASE tables beside shapefiles, values as trimmed texts."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                n, head, size = struct.unpack_from("<ihh", data, 4)
                fields = [(data[k : k + 11].split(b"\0")[0].decode("latin-1"), data[k + 16]) for k in range(32, head - 1, 32) if data[k] != 0x0D]
                rows = []
                for r in range(n):
                    at, row = head + r * size + 1, {}
                    for name, width in fields:
                        row[name] = data[at : at + width].decode("latin-1").strip()
                        at += width
                    rows.append(list(row.items()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array(rows, pa.map_(pa.string(), pa.string()))], ["file", "number", "attributes"]
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dbf").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.dbf$", 1).alias("file"), "content")
    return files.mapInArrow(run, "file string, number int, attributes map<string,string>")


def shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """Shapes with their attributes, of all shapefiles of a folder."""
    return read_shapes(spark, path).join(read_attributes(spark, path), ["file", "number"], "left")


def _inside(x: Column, y: Column, rings: Column) -> Column:
    """Ray casting over all rings, so holes are outside; left and lower borders belong to a polygon."""

    def ring(odd: Column, r: Column) -> Column:
        def edge(odd: Column, i: Column) -> Column:
            a, b = F.get(r, i), F.get(r, i + 1)
            crosses = (a["y"] > y) != (b["y"] > y)
            left = x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
            return odd != (crosses & F.coalesce(left, F.lit(False)))

        return F.when(F.size(r) < 2, odd).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), odd, edge))

    return F.aggregate(rings, F.lit(False), ring)


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", rings: str = "rings", cell: float = 1.0, how: str = "inner") -> DataFrame:
    """Points with the columns of each polygon that holds them; ``how``: inner, semi (points in any) or anti.

    Polygons are listed under the grid cells that their boxes touch, so the join is an equi-join on cells; the exact test
    runs on what meets there.  Choose ``cell`` near the size of a polygon.
    """
    all_x, all_y = (F.flatten(F.transform(quoted(rings), lambda r: r["x"])), F.flatten(F.transform(quoted(rings), lambda r: r["y"])))
    at = lambda c: F.floor(c / cell)
    span = lambda c: F.sequence(at(F.array_min(c)), at(F.array_max(c)))
    listed = polygons.where(F.size(all_x) > 0).withColumn("__cx", F.explode(span(all_x))).withColumn("__cy", F.explode(span(all_y)))
    placed = points.withColumn("__px", at(quoted(x))).withColumn("__py", at(quoted(y)))
    listed = listed.withColumnRenamed(rings, "__rings")
    on = (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")) & _inside(quoted(x), quoted(y), F.col("__rings"))
    kind = {"inner": "inner", "semi": "left_semi", "anti": "left_anti"}[how]
    return placed.join(listed, on, kind).drop("__px", "__py", "__cx", "__cy", "__rings")
