"""Places: table rows, units, grid cells, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import rules as R

#: Header words and the role of their column; the first column of a role counts. Fixed values.
ROLES = {"address": "address", "street": "address", "city": "city", "zip": "zip", "zip code": "zip", "county": "county", "tract": "tract"}


def table_rows(tables: DataFrame, column: str = "table_data", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of JSON tables whose first row names the columns: row_index, address, city, zip, county, tract.
    What is no JSON table gives no row."""
    grid = tables.withColumn("_g", F.from_json(column, "array<array<string>>")).where("size(_g) > 1")
    head = F.transform(F.col("_g")[0], lambda h: F.lower(F.trim(h)))
    out = grid.select(*keep, head.alias("_h"), F.posexplode(F.slice("_g", 2, 1_000_000_000)).alias("_i", "_r"))

    def value(role):
        at = [F.array_position("_h", name) for name, r in ROLES.items() if r == role]
        first = F.array_min(F.array(*[F.when(p > 0, p) for p in at]))
        return F.when(first.isNotNull(), F.try_element_at("_r", first.cast("int"))).alias(role)

    return out.select(*keep, (F.col("_i") + 1).cast("bigint").alias("row_index"), *[value(r) for r in dict.fromkeys(ROLES.values())])


def units(mentions: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """A row for each spatial unit of a mention (columns lat, lon, zip, city, county, tract, state)."""
    c = F.col
    state = F.coalesce(c("state"), F.lit("TX"))
    made = F.array(
        F.struct(F.lit("point").alias("unit_type"), F.when(c("lat").isNotNull() & c("lon").isNotNull(), F.concat_ws(",", F.format_string("%.6f", c("lat")), F.format_string("%.6f", c("lon")))).alias("unit_value")),
        F.struct(F.lit("zip").alias("unit_type"), c("zip").alias("unit_value")),
        F.struct(F.lit("city").alias("unit_type"), F.when(c("city").isNotNull(), F.concat_ws(", ", c("city"), state)).alias("unit_value")),
        F.struct(F.lit("county").alias("unit_type"), c("county").alias("unit_value")),
        F.struct(F.lit("tract").alias("unit_type"), F.when(c("county").isNotNull() & c("tract").isNotNull(), F.concat_ws("|tract:", c("county"), c("tract"))).alias("unit_value")),
    )
    return mentions.select(*keep, F.inline(F.filter(made, lambda u: u["unit_value"].isNotNull())))


def in_texas(lat, lon):
    """Whether a point lies in the state's bounding box, with the sign of the longitude put right."""
    west = F.when(lon > 0, -lon).otherwise(lon)
    return lat.between(24.0, 37.0) & west.between(-107.0, -93.0)


def grid_cell(lat, lon, per_degree: int = 20):
    """Name of a fixed-size latitude/longitude cell; a plain grid, not a hexagonal one."""
    return F.concat_ws("_", F.floor(lat * per_degree).cast("string"), F.floor(lon * per_degree).cast("string"))


def carried(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The last known value at or before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def merged_spans(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans of a key as one."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    fresh = (F.col(start) > F.coalesce(F.max(end).over(before), F.lit(-1))).cast("int")
    out = df.select(key, start, end, fresh.alias("_f")).withColumn("_g", F.sum("_f").over(up_to))
    return out.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def carried_once(df: DataFrame, keys: list[str], order: str, sets: str, value: str, uses: str, out: str) -> DataFrame:
    """df with `out`: at a row that uses it, the value of the last row (the row itself included) that set one, if no row
    since then has used it; else null. A row that sets takes the place of what was kept, by null too. sets and uses are
    conditions; a null condition is false; order is distinct within keys."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    set_at = F.last(F.when(F.expr(sets), F.struct(F.col(order).alias("at"), F.col(value).alias("value"))), ignorenulls=True).over(so_far)
    used_at = F.last(F.when(F.expr(uses), F.col(order)), ignorenulls=True).over(before)
    found = df.withColumn("_set", set_at).withColumn("_used", used_at)
    fresh = F.expr(uses) & (F.col("_used").isNull() | (F.col("_set.at") > F.col("_used")))
    return found.withColumn(out, F.when(fresh, F.col("_set.value"))).drop("_set", "_used")


def cell(latitude: Column, longitude: Column, level: int) -> Column:
    """The cell of a point on a grid of 2^level by 2^level, as `level` digits 0 to 3; a cell's parent is the cell without
    its last digit. Null and impossible points have none; the poles' and the date line's far edge count to the last cell."""
    side = 1 << level
    place = lambda share: F.least(F.floor(share * side), F.lit(side - 1)).cast("int")
    x, y = place((longitude + 180) / 360), place((90 - latitude) / 180)
    both = F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda p: F.concat_ws("", *[(p["x"].bitwiseAND(1 << i).cast("boolean").cast("int") + 2 * p["y"].bitwiseAND(1 << i).cast("boolean").cast("int")).cast("string") for i in range(level - 1, -1, -1)]))
    return F.when(latitude.between(-90, 90) & longitude.between(-180, 180), F.element_at(both, 1))


def cells_by_level(points: DataFrame, latitude: str, longitude: str, levels: list[int], value: str) -> DataFrame:
    """level, cell, parent, n, total of the cells of each level: points are counted once, in the finest cells, and only
    those counts go up; so a parent's numbers are the sums of its children's. Points without a cell are left out."""
    finest = max(levels)
    own = points.select(cell(F.col(latitude), F.col(longitude), finest).alias("_cell"), F.col(value).alias("_v")).where("_cell IS NOT NULL")
    counts = own.groupBy("_cell").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))
    up = counts.select(F.explode(F.array(*map(F.lit, sorted(levels)))).alias("level"), "_cell", "n", "total")
    named = up.withColumn("cell", F.expr("left(_cell, level)")).withColumn("parent", F.expr("left(_cell, level - 1)"))
    return named.groupBy("level", "cell", "parent").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


#: How a page's text names a place, where no mention does. Fixed values.
CITY_TX, ZIP_LABEL = "([A-Za-z .'-]+),\\s*TX\\s*(\\d{5})?", "(?i)\\b(?:zip\\s*code|zip)\\b\\s*[:#-]*\\s*(\\d{5})"


def page_places(pages: DataFrame, mentions: DataFrame, key: list[str], text: str, order: str) -> DataFrame:
    """key, city, zip of each page: those of its first mention (key, city, zip) that has either; on a page without one,
    what the text says. What neither knows is null. Pages are distinct by key."""
    known = mentions.where("city IS NOT NULL OR zip IS NOT NULL").groupBy(*key).agg(F.min_by(F.struct("city", "zip"), F.struct(order, "city", "zip")).alias("_m"))
    said = lambda pattern, k: R.nullif_empty(F.trim(F.regexp_extract(text, pattern, k)))
    found = pages.select(*key, text).join(known, key, "left")
    of = lambda name, c: F.when(F.col("_m").isNotNull(), F.col("_m")[name]).otherwise(c).alias(name)
    return found.select(*key, of("city", F.initcap(said(CITY_TX, 1))), of("zip", F.coalesce(said(CITY_TX, 2), said(ZIP_LABEL, 1))))
