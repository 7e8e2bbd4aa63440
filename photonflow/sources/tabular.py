"""Readers and writers of point tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Standard short names of fit-result fields (fixed values).
ALIASES = {
    "x": "fitResults_x0", "y": "fitResults_y0", "z": "fitResults_z0", "A": "fitResults_A", "sig": "fitResults_sigma",
    "error_x": "fitError_x0", "error_y": "fitError_y0", "error_z": "fitError_z0", "t": "tIndex",
}
DEPTH = 3


def flatten_structs(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Struct fields as columns named parent_child, to a depth of three; deeper structs raise ValueError."""

    def fields(schema: T.StructType, path: tuple[str, ...]) -> list:
        if len(path) > depth:
            raise ValueError(f"nested too deeply: {'.'.join(path)}")
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            out += fields(f.dataType, here) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias("_".join(here))]
        return out

    return df.select(*fields(df.schema, ()))


def with_aliases(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Short names beside the fields that exist."""
    return df.withColumns({short: F.col(field) for short, field in aliases.items() if field in df.columns and short not in df.columns})


def read_text(spark: SparkSession, path: str, columns: Sequence[str], delimiter: str = ",", comment: str = "#") -> DataFrame:
    """Delimited numbers with the given column names, as floats; lines with a NaN or an unreadable value are dropped."""
    schema = T.StructType([T.StructField(c, T.FloatType()) for c in columns])
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("comment", comment).option("ignoreLeadingWhiteSpace", True).csv(path, sep=delimiter)
    for c in columns:
        df = df.where(F.col(f"`{c}`").isNotNull() & ~F.isnan(f"`{c}`"))
    return df


def sniff_text(spark: SparkSession, path: str) -> dict[str, object]:
    """Delimiter and column names of a text table, from the head of the file alone."""
    lines = [r[0] for r in spark.read.text(path).limit(20).collect()]
    head = [x.lstrip("#").strip() for x in lines if x.startswith("#")]
    body = [x for x in lines if x.strip() and not x.startswith("#")]
    delimiter = "\t" if body and body[0].count("\t") >= body[0].count(",") and "\t" in body[0] else ","
    first = [p.strip().strip('"') for p in body[0].split(delimiter)] if body else []
    numeric = lambda s: s.replace(".", "", 1).replace("e", "", 1).replace("-", "").replace("+", "").isdigit()
    named = bool(first) and not all(map(numeric, first))
    columns = first if named else [p.strip() for p in head[-1].split(delimiter)] if head else [f"c{i}" for i in range(len(first))]
    return {"delimiter": delimiter, "columns": [c.replace(" ", "_") for c in columns], "header": named}


def read_table(spark: SparkSession, uri: str) -> DataFrame:
    """A table by its extension: parquet, orc, json, jsonl, csv or txt; anything else is tried as Parquet."""
    path, _, _ = uri.partition("?")
    match path.rsplit(".", 1)[-1].lower():
        case "csv" | "txt" | "tsv":
            found = sniff_text(spark, path)
            return spark.read.option("comment", "#").option("inferSchema", True).csv(path, sep=found["delimiter"], header=found["header"]).toDF(*found["columns"])
        case "json":
            return spark.read.json(path, multiLine=True)
        case "jsonl":
            return spark.read.json(path)
        case "orc":
            return spark.read.orc(path)
    return spark.read.parquet(path)


def random_points(spark: SparkSession, n: int, x_max: float, y_max: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row_id"), (F.rand(seed) * x_max).alias("x"), (F.rand(seed + 1) * y_max).alias("y"))


def metadata_value(json_column, path: str, default: float):
    """A number in a JSON metadata column, or a default."""
    return F.coalesce(F.get_json_object(json_column, f"$.{path}").try_cast("double"), F.lit(default))


def write_table(df: DataFrame, uri: str, append: bool = False) -> None:
    """Write once by default: an existing target is an error; aggregated results append."""
    out = df.write.mode("append" if append else "errorifexists")
    match uri.rsplit(".", 1)[-1].lower():
        case "csv":
            out.csv(uri, header=True)
        case "json" | "jsonl":
            out.json(uri)
        case "orc":
            out.orc(uri)
        case _:
            out.parquet(uri)


def file_table(spark: SparkSession, pattern: str) -> DataFrame:
    """Files that match a glob: path, size, time. Contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("time"))
