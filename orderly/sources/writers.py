"""Sinks: strict JSON, union-of-keys CSV, rounded gzip CSV, partitioned JSON lines, interval text grids, reports."""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderly.functions.scalar import python_round


def json(df: DataFrame, path: str) -> None:
    """JSON lines; a NaN or infinite number is an error."""
    checks = [
        F.when(F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf")), F.raise_error(F.lit(f"{f.name} is not finite"))).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema
    ]
    df.select(*checks).write.json(path)


def replace_folder(spark, fresh: str, path: str) -> None:
    """Move a complete folder to path. What was there before goes when the new one is in place, and comes back if that fails."""
    new, old, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, f"{fresh}.old", path))
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = files.exists(target)
    if there and not files.rename(target, old):
        raise OSError(f"could not move {path} away")
    if not moved(files, new, target):
        if there:
            files.rename(old, target)
        raise OSError(f"could not move {fresh} to {path}")
    files.delete(old, True)


def moved(files, new, target) -> bool:
    return files.rename(new, target)


def publish(df: DataFrame, path: str) -> None:
    """JSON lines that appear under ``path`` all at once: written beside it first, then renamed. A write or a move that fails leaves what
    was there before."""
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    json(df, fresh)
    replace_folder(df.sparkSession, fresh, path)


def flat(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def csv_union(tables: list[DataFrame], path: str) -> None:
    """Tables under the union of their columns, in order of appearance."""
    out = flat(tables[0])
    for df in tables[1:]:
        out = out.unionByName(flat(df), allowMissingColumns=True)
    out.write.option("header", "true").option("escape", '"').csv(path)


def csv_rounded(df: DataFrame, path: str, places: dict[str, int], sep: str = ",") -> None:
    """Gzip CSV (or TSV) with columns rounded to so many places as Python does it, NULL as blank."""
    df.withColumns({c: python_round(F.col(c), n) for c, n in places.items()}).write.option("header", "true").option("sep", sep).option("compression", "gzip").csv(path)


def json_by(df: DataFrame, path: str, column: str) -> None:
    """JSON lines in a folder for each value of a column."""
    df.write.partitionBy(column).json(path)


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def text_grids(tiles: DataFrame, key: str) -> DataFrame:
    """key and the text of an interval grid with one tier, from tiles (key, xmin, xmax, label) that cover each key's span."""
    row = F.struct(F.col("xmin"), F.col("xmax"), F.col("label"))
    grouped = tiles.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("r"))
    number = lambda c: F.format_string("%.6f", c)
    body = F.transform("r", lambda x: F.concat_ws("\n", number(x["xmin"]), number(x["xmax"]), quoted(x["label"])))
    lo, hi = F.element_at("r", 1)["xmin"], F.element_at("r", -1)["xmax"]
    head = [F.lit('File type = "ooTextFile"'), F.lit('Object class = "TextGrid"'), F.lit(""), number(lo), number(hi), F.lit("<exists>"), F.lit("1")]
    tier = [F.lit('"IntervalTier"'), quoted(F.lit("labels")), number(lo), number(hi), F.size("r").cast("string")]
    return grouped.select(key, F.concat_ws("\n", *head, *tier, F.array_join(body, "\n")).alias("text"))


def tiered_grids(rows: DataFrame, spans: DataFrame, key: str, tiers: list[tuple[str, str]]) -> DataFrame:
    """key and the text of a grid of several tiers, in the long form. tiers: names in order, each "interval" or "point". rows: key, tier, xmin, xmax, label; a point stands at xmin, and
    points at one time become one, their labels in order and with a semicolon between. Between intervals, which must be disjoint, stand ones without a label. spans: key,
    from, to, a row for each grid; tiers without rows are there all the same. Line ends in labels are written as spaces."""
    number = lambda c: F.format_string("%.9f", c)
    names = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(n).alias("tier"), F.lit(kind).alias("kind")) for k, (n, kind) in enumerate(tiers, 1)])
    every = spans.select(key, F.col("from"), F.col("to"), F.inline(names))
    text = F.regexp_replace(F.coalesce("label", F.lit("")), r"[\r\n]+", " ")
    known = rows.select(F.col(key).alias("__key"), F.col("tier").alias("__tier"), "xmin", "xmax", text.alias("label")).join(every, F.col("__key").eqNullSafe(F.col(key)) & (F.col("__tier") == F.col("tier")))
    order = Window.partitionBy(key, "at").orderBy("xmin")
    inside = known.where("kind = 'interval'")
    gaps = inside.select(key, "at", F.coalesce(F.lag("xmax").over(order), "from").alias("lo"), F.col("xmin").alias("hi"))
    rest = every.where("kind = 'interval'").join(inside.groupBy(F.col(key).alias("__key"), F.col("at").alias("__at")).agg(F.max("xmax").alias("last")), F.col(key).eqNullSafe(F.col("__key")) & (F.col("at") == F.col("__at")), "left")
    gaps = gaps.unionByName(rest.select(key, "at", F.coalesce("last", "from").alias("lo"), F.col("to").alias("hi"))).where("hi > lo")
    points = known.where("kind = 'point'").groupBy(key, "at", "xmin").agg(F.array_join(F.sort_array(F.collect_list("label")), "; ").alias("label"))
    entries = inside.select(key, "at", "xmin", "xmax", "label").unionByName(gaps.select(key, "at", F.col("lo").alias("xmin"), F.col("hi").alias("xmax"), F.lit("").alias("label")))
    entries = entries.unionByName(points.select(key, "at", "xmin", F.col("xmin").alias("xmax"), "label"))
    listed = entries.groupBy(F.col(key).alias("__key"), F.col("at").alias("__at")).agg(F.sort_array(F.collect_list(F.struct("xmin", "xmax", "label"))).alias("e"))
    full = every.join(listed, F.col(key).eqNullSafe(F.col("__key")) & (F.col("at") == F.col("__at")), "left").withColumn("e", F.coalesce("e", F.array().cast(listed.schema["e"].dataType)))
    interval = F.col("kind") == "interval"
    lines = F.transform(
        "e",
        lambda x, i: F.when(
            interval, F.concat_ws("\n", F.concat(F.lit("        intervals ["), i + 1, F.lit("]:")), F.concat(F.lit("            xmin = "), number(x["xmin"])), F.concat(F.lit("            xmax = "), number(x["xmax"])), F.concat(F.lit("            text = "), quoted(x["label"])))
        ).otherwise(F.concat_ws("\n", F.concat(F.lit("        points ["), i + 1, F.lit("]:")), F.concat(F.lit("            number = "), number(x["xmin"])), F.concat(F.lit("            mark = "), quoted(x["label"])))),
    )
    head = [
        F.concat(F.lit("    item ["), "at", F.lit("]:")), F.concat(F.lit("        class = "), quoted(F.when(interval, "IntervalTier").otherwise("TextTier"))), F.concat(F.lit("        name = "), quoted(F.col("tier"))),
        F.concat(F.lit("        xmin = "), number(F.col("from"))), F.concat(F.lit("        xmax = "), number(F.col("to"))),
        F.concat(F.when(interval, "        intervals: size = ").otherwise("        points: size = "), F.size("e")),
    ]
    tier = F.array_join(F.concat(F.array(*head), lines), "\n")
    grids = full.withColumn("tier_text", tier).groupBy(key, "from", "to").agg(F.sort_array(F.collect_list(F.struct("at", "tier_text"))).alias("t"))
    top = ['File type = "ooTextFile"', 'Object class = "TextGrid"', ""]
    start = [*map(F.lit, top), F.concat(F.lit("xmin = "), number(F.col("from"))), F.concat(F.lit("xmax = "), number(F.col("to"))), F.lit("tiers? <exists>"), F.concat(F.lit("size = "), F.size("t")), F.lit("item []:")]
    return grids.select(key, F.array_join(F.concat(F.array(*start), F.transform("t", lambda x: x["tier_text"])), "\n").alias("text"))


GRID_TOKEN = re.compile(r'"((?:[^"]|"")*)"|\[[^\]]*\]|(?<![\w.])(-?\d+(?:\.\d+)?)')


def grid_entries(text: str | None) -> list[tuple[int, str, str, float, float, str]]:
    """(tier from 1, name, kind, xmin, xmax, label) of the entries of a grid, of the long form or the short one, whose values come in the same order."""
    found = [m for m in GRID_TOKEN.finditer(text or "") if not m[0].startswith("[")]
    values = iter([m[1].replace('""', '"') if m[0].startswith('"') else float(m[2]) for m in found][4:])  # behind the file's type, the object's and the span
    out = []
    for at in range(1, int(next(values, 0)) + 1):
        kind, name, _, _, size = (next(values) for _ in range(5))
        for _ in range(int(size)):
            start = next(values)
            end = next(values) if kind == "IntervalTier" else start
            out.append((at, name, "interval" if kind == "IntervalTier" else "point", start, end, next(values)))
    return out


ENTRY = T.StructType([T.StructField(n, t) for n, t in (("number", T.IntegerType()), ("tier", T.StringType()), ("kind", T.StringType()), ("xmin", T.DoubleType()), ("xmax", T.DoubleType()), ("label", T.StringType()))])


@F.pandas_udf(T.ArrayType(ENTRY))
def read_tiers(texts: pd.Series) -> pd.Series:
    return texts.map(grid_entries)


def read_text_grid(text: Column) -> Column:
    """(xmin, xmax, label) of the single tier of such a text."""
    lines = F.split(text, "\n", -1)
    start = F.sequence(F.lit(13), F.size(lines), F.lit(3))
    return F.transform(
        start,
        lambda i: F.struct(
            F.element_at(lines, i).cast("double").alias("xmin"),
            F.element_at(lines, i + 1).cast("double").alias("xmax"),
            F.replace(F.regexp_extract(F.element_at(lines, i + 2), '^"(.*)"$', 1), F.lit('""'), F.lit('"')).alias("label"),
        ),
    )


def markdown(df: DataFrame, order: list[str], most: int = 10_000) -> DataFrame:
    """One row: a report table of a small result, as text. More than ``most`` rows are an error: a report is read by people, and one text holds it."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a report of more than {most} rows")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("pending")) for c in df.columns]), F.lit(" |"))
    rows = df.agg(F.sort_array(F.collect_list(F.struct(*order, cells.alias("__cells")))).alias("r"))
    head = "\n".join(("| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)))
    return rows.select(F.concat_ws("\n", F.lit(head), F.array_join(F.transform("r", lambda x: x["__cells"]), "\n")).alias("report"))
