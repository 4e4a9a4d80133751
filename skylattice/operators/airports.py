"""Airports: approach signal, filtered tables, search, nearest field, runways in view.

Runways stay rows of their own (``airport_runways``); an airport only carries their count. The
nested form for tile payloads is :func:`nest_runways`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.functions import airports as A
from skylattice.functions import geo, tilemath
from skylattice.operators import nearest, quadtree
from skylattice.session import materialize


def approach_idents(runways: DataFrame, navaids: DataFrame) -> DataFrame:
    """Airports with an instrument approach: a lighted open runway, or a navaid on the field."""
    lighted = runways.filter(A.is_lighted_open()).select(A.clean_ident("airport_ident").alias("ident"))
    on_field = navaids.select(A.clean_ident("associated_airport").alias("ident"))
    return lighted.unionByName(on_field).filter(F.col("ident") != "").distinct()


def airport_runways(runways: DataFrame, *, include_closed: bool = True) -> DataFrame:
    """Usable runways, one row each, in ``row_no`` order per airport.

    The key is trimmed but keeps its case, unlike airport identifiers, so odd-case keys never attach.
    """
    kept = runways.filter(~A.is_helipad())
    if not include_closed:
        kept = kept.filter(F.trim(F.coalesce("closed", F.lit(""))) != "1")
    located = kept.select(
        F.trim(F.coalesce("airport_ident", F.lit(""))).alias("ident"),
        "row_no",
        A.parse_coord("le_latitude_deg", "lat").alias("lat1"),
        A.parse_coord("le_longitude_deg", "lon").alias("lon1"),
        A.parse_coord("he_latitude_deg", "lat").alias("lat2"),
        A.parse_coord("he_longitude_deg", "lon").alias("lon2"),
    )
    return located.filter(F.col("ident") != "").dropna(subset=["lat1", "lon1", "lat2", "lon2"])


def _parsed(airports: DataFrame) -> DataFrame:
    return airports.withColumns(
        {
            "tier": A.airport_tier("type"),
            "lat": A.parse_coord("latitude_deg", "lat"),
            "lon": A.parse_coord("longitude_deg", "lon"),
        }
    )


def build_airports(
    airports: DataFrame, runways: DataFrame, approach: DataFrame, *, include_closed: bool = True
) -> DataFrame:
    """Airport table: ident, lat, lon, tier, instrument_approach, runway_count."""
    candidates = (
        _parsed(airports)
        .withColumn("ident", A.clean_ident("ident"))
        .filter(A.valid_icao("ident") & (F.col("tier") > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )
    flagged = candidates.join(approach.select("ident", F.lit(True).alias("_a")), "ident", "left").withColumn(
        "instrument_approach", F.coalesce("_a", F.lit(False))
    )
    kept = flagged.filter(A.keep_airport("tier", "scheduled_service", "instrument_approach"))
    # Counted before the join: however many runways one key has, one row per key travels.
    counts = airport_runways(runways, include_closed=include_closed).groupBy("ident").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return kept.join(counts, "ident", "left").select(
        "ident", "lat", "lon", "tier", "instrument_approach", F.coalesce("_n", F.lit(0)).alias("runway_count")
    )


def nest_runways(airports: DataFrame, runways: DataFrame, *, most: int | None = 255) -> DataFrame:
    """Add ``runways`` array<struct<lat1,lon1,lat2,lon2>> in row order, [] without any.

    An airport of more than ``most`` runways is an error: 255 are what a device reads of one airport. None
    takes any number, for :func:`merge_layers` and for payloads that only this package reads.
    """
    within = F.lit(True) if most is None else F.col("runway_count") <= most
    checked = airports.withColumn(
        "runway_count",
        F.when(within, F.col("runway_count")).otherwise(
            F.raise_error(F.concat(F.lit("too many runways at "), F.col("ident"))).cast("long")
        ),
    )
    wanted = checked.filter(F.col("runway_count") > 0).select("ident").distinct()
    nested = (
        runways.join(wanted, "ident", "left_semi")
        .groupBy("ident")
        .agg(F.sort_array(F.collect_list(F.struct("row_no", "lat1", "lon1", "lat2", "lon2"))).alias("_r"))
    )
    none = F.array().cast("array<struct<lat1:double,lon1:double,lat2:double,lon2:double>>")
    plain = F.transform("_r", lambda r: F.struct(r["lat1"].alias("lat1"), r["lon1"].alias("lon1"), r["lat2"].alias("lat2"), r["lon2"].alias("lon2")))
    return checked.join(nested, "ident", "left").withColumn("runways", F.coalesce(plain, none)).drop("_r")


def airport_order() -> list[Column]:
    """Airports that share an ident stand by place, so that a cut among them is always the same."""
    return [F.desc("tier"), F.col("ident"), F.col("lat"), F.col("lon")]


def top_hubs(airports: DataFrame, *, n: int = C.OVERVIEW_HUBS) -> DataFrame:
    """The first ``n`` large airports, without runways; a top-n over per-task tops."""
    hubs = airports.filter(F.col("tier") >= 3).orderBy(*airport_order()).limit(n)
    return hubs.withColumn("runway_count", F.lit(0).cast("long"))


def airport_index(airports: DataFrame, runways: DataFrame, navaids: DataFrame) -> DataFrame:
    """Search table: icao, iata, city, name, lat, lon, iap (0/1) and the tier it is ordered by.

    Keeps other rows than :func:`build_airports`: no approach elevation, no range check on
    coordinates, any four characters, identifiers in their own case.
    """
    approach = approach_idents(runways, navaids).select(F.col("ident").alias("_key"), F.lit(1).alias("_iap"))

    def number(name: str) -> Column:
        value = F.trim(name).try_cast("double")
        return F.when(~F.isnan(value), F.round(value, 5))

    rows = airports.select(
        F.trim(F.coalesce("ident", F.lit(""))).alias("icao"),
        F.trim(F.coalesce("iata_code", F.lit(""))).alias("iata"),
        F.coalesce("municipality", F.lit("")).alias("city"),
        F.coalesce("name", F.lit("")).alias("name"),
        number("latitude_deg").alias("lat"),
        number("longitude_deg").alias("lon"),
        A.airport_tier("type").alias("tier"),
        "scheduled_service",
    ).filter(A.keep_index_airport("tier", "scheduled_service") & (F.length("icao") == 4))
    rows = rows.dropna(subset=["lat", "lon"]).withColumn("_key", A.clean_ident("icao"))
    return rows.join(approach, "_key", "left").select(
        "icao", "iata", "city", "name", "lat", "lon", F.coalesce("_iap", F.lit(0)).alias("iap"), "tier"
    )


# --- search ---------------------------------------------------------------------------------

_GRAM = 3
_ROW = "_row_id"


class SearchIndex(NamedTuple):
    """Stored tables that searches meet.

    ``rows``: of every distinct text the first rows in index order, as many as a search may show, under
    kind ('code' or 'name') and text. ``lists``: gram, kind, text. ``lengths``: gram, n.
    """

    rows: DataFrame
    lists: DataFrame
    lengths: DataFrame
    columns: list[str]
    limit: int


def _grams(text: Column, *sizes: int) -> Column:
    """The distinct pieces of these lengths."""

    def of(size: int) -> Column:
        starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))), F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(size) for size in sizes]))


def build_search_index(index: DataFrame, *, limit: int = C.SEARCH_LIMIT) -> SearchIndex:
    """Texts before rows: equal texts are listed once, and a row counts only while fewer than ``limit`` rows
    with the same text come before it, for these would be shown first."""
    texts = [
        F.struct(F.lit(kind).alias("kind"), F.lower(F.coalesce(column, F.lit(""))).alias("text"))
        for column, kind in (("icao", "code"), ("iata", "code"), ("city", "name"), ("name", "name"))
    ]
    listed = index.withColumn(_ROW, F.monotonically_increasing_id()).withColumn("_t", F.explode(F.array_distinct(F.array(*texts))))
    order = Window.partitionBy("_t").orderBy(F.desc("tier"), "icao", "name", _ROW)
    first = listed.filter(F.col("_t.text") != "").withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= limit)
    rows = materialize(first.select(F.col("_t.kind").alias("_kind"), F.col("_t.text").alias("_text"), _ROW, *index.columns))
    distinct = rows.select("_kind", "_text").distinct()
    lists = materialize(distinct.select(F.explode(_grams(F.col("_text"), *range(1, _GRAM + 1))).alias("_gram"), "_kind", "_text"))
    lengths = lists.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    return SearchIndex(rows, lists, lengths, index.columns, limit)


def _matches(stored: SearchIndex, asked: DataFrame) -> DataFrame:
    """(q, kind, text, score) of the texts that hold a query: each query meets the list of its rarest gram only."""
    grams = F.when(F.length("q") <= _GRAM, F.array("q")).otherwise(_grams(F.col("q"), _GRAM))
    rated = asked.select("q", F.explode(grams).alias("_gram")).join(stored.lengths, "_gram", "left")
    # A query with a gram that no text has matches nothing.
    rarest = rated.groupBy("q").agg(F.min_by("_gram", F.coalesce("_n", F.lit(0))).alias("_gram"))
    met = rarest.join(stored.lists, "_gram").filter(F.col("_text").contains(F.col("q")))
    code = F.when(F.col("_text") == F.col("q"), 1000).when(F.col("_text").startswith(F.col("q")), 500).otherwise(100)
    name = F.when(F.col("_text").startswith(F.col("q")), 200).otherwise(50)
    return met.select("q", "_kind", "_text", F.when(F.col("_kind") == "code", code).otherwise(name).alias("score"))


def airport_search(index: DataFrame | SearchIndex, queries: DataFrame, *, limit: int = C.SEARCH_LIMIT) -> DataFrame:
    """Best ``limit`` index rows per query by score, then by index order (tier, icao, name).

    ``queries`` has query_id and q; equal queries are answered once. ``index`` may be a stored
    :class:`SearchIndex` built for at least ``limit`` rows.
    """
    stored = index if isinstance(index, SearchIndex) else build_search_index(index, limit=limit)
    if limit > stored.limit:
        raise ValueError(f"the index was built for {stored.limit} rows a search")
    asked = queries.withColumn("q", F.lower(F.trim("q"))).filter(F.col("q") != "")
    hits = _matches(stored, asked.select("q").distinct()).join(stored.rows, ["_kind", "_text"])
    order = [F.desc("score"), F.desc("tier"), "icao", "name", _ROW]
    by_query = Window.partitionBy("q").orderBy(*order)
    # A row comes under each of its up to four texts; the best of them counts.
    few = hits.withColumn("_rn", F.row_number().over(by_query)).filter(F.col("_rn") <= 4 * limit)
    own = Window.partitionBy("q", _ROW).orderBy(F.desc("score"), "_rn")
    once = few.withColumn("_rn", F.row_number().over(own)).filter(F.col("_rn") == 1)
    best = once.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= limit)
    found = best.select("q", "rank", "score", *stored.columns)
    return asked.select("query_id", "q").join(found, "q").select("query_id", "q", "rank", "score", *stored.columns)


def resolve_points(requests: DataFrame, index: DataFrame) -> DataFrame:
    """``request_id, text`` to coordinates: 'lat,lon' is parsed and range-checked, else the best search hit."""
    asked = requests.withColumn("_t", F.trim("text"))
    leading = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

    def number(part: int) -> Column:
        piece = F.get(F.split("_t", ","), F.lit(part))
        return F.regexp_extract(piece, leading, 1).try_cast("double")

    typed = (
        asked.filter(F.col("_t").contains(","))
        .select("request_id", number(0).alias("lat"), number(1).alias("lon"))
        .filter(geo.valid_lat_lon("lat", "lon"))
        .withColumn("label", F.format_string("%.4f,%.4f", "lat", "lon"))
    )
    named = asked.filter(~F.col("_t").contains(",")).select(F.col("request_id").alias("query_id"), F.col("_t").alias("q"))
    found = airport_search(index, named, limit=1).select(
        F.col("query_id").alias("request_id"), "lat", "lon", F.col("icao").alias("label")
    )
    return typed.unionByName(found)


def geocode_clean(addresses: DataFrame) -> DataFrame:
    """Numeric hits only, at most five per query of four or more characters, in hit order."""
    usable = addresses.filter(F.length(F.trim("query")) >= C.MIN_GEOCODE_CHARS).select(
        "query",
        "hit_no",
        F.coalesce(F.col("display_name").cast("string"), F.lit("")).alias("display_name"),
        F.col("lat").try_cast("double").alias("lat"),
        F.col("lon").try_cast("double").alias("lon"),
    )
    finite = usable.filter(
        F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
        & (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))
    )
    first = Window.partitionBy("query").orderBy("hit_no")
    return finite.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= C.GEOCODE_LIMIT).drop("_rn")


# --- nearest field --------------------------------------------------------------------------

def nearest_approach_airport(
    sites: DataFrame, airports: DataFrame, *, same_tile_zoom: int | None = None
) -> DataFrame:
    """Each site's nearest airport with an instrument approach: icao, lat/lon, dist_nm; ties by ident.

    ``airports`` has ident, lat, lon, instrument_approach. With ``same_tile_zoom`` only the site's
    own tile is searched (sites in tiles without one are left out). Otherwise the search is exact
    over the whole map (:mod:`nearest`).
    """
    points = airports.filter("instrument_approach").select(F.col("ident").alias("id"), "lat", "lon")
    if same_tile_zoom is None:
        found = nearest.nearest(sites, points)
    else:
        zoom = same_tile_zoom
        tile = tilemath.tile_x(zoom, "lon").cast("long") * (1 << zoom) + tilemath.tile_y(zoom, "lat")
        found = nearest.nearest(sites.withColumn("_tile", tile), points.withColumn("_tile", tile), apart="_tile")
    best = {"icao": "id", "icao_lat": "lat", "icao_lon": "lon", "dist_nm": "dist_nm"}
    return found.select(*sites.columns, *[F.col("_best")[field].alias(name) for name, field in best.items()])


def reference_label(nearest: DataFrame) -> DataFrame:
    """'N.n nm NE of KXXX' seen from the airport, magnetic; just the identifier within 0.1 nm."""
    true_bearing = geo.bearing_deg("icao_lat", "icao_lon", "lat", "lon")
    magnetic = geo.magnetic_bearing(true_bearing, geo.magnetic_declination("icao_lat", "icao_lon"))
    text = F.format_string("%.1f nm %s of %s", F.col("dist_nm"), geo.compass8(magnetic), F.col("icao"))
    return nearest.withColumn("label", F.when(F.col("dist_nm") <= 0.1, F.col("icao")).otherwise(text))


# --- views ----------------------------------------------------------------------------------


def airports_near(airports: DataFrame, views: DataFrame, *, hot_rows: int | None = None) -> DataFrame:
    """Airports within ``radius_km`` of each view (view_id, center_lat, center_lon, radius_km)."""
    box, touches = quadtree.disc_box("center_lat", "center_lon", F.col("radius_km"), C.KM_PER_DEG)
    met = quadtree.meet(airports, views, box, touches=touches, hot_rows=hot_rows)
    dist = geo.distance_km("center_lat", "center_lon", "lat", "lon")
    return met.withColumn("dist_km", dist).filter(F.col("dist_km") <= F.col("radius_km"))


def _visible(near: DataFrame, runways: DataFrame) -> DataFrame:
    """``near`` with row_no and ``_cut`` of every runway that shows in its view, cut to the view's disc, in km from its centre."""
    ends = [
        geo.offset_x_km("center_lat", "center_lon", "lon1"),
        geo.offset_y_km("center_lat", "lat1"),
        geo.offset_x_km("center_lat", "center_lon", "lon2"),
        geo.offset_y_km("center_lat", "lat2"),
    ]
    met = near.join(runways.select("ident", "row_no", "lat1", "lon1", "lat2", "lon2"), "ident")
    placed = met.withColumns(dict(zip(("_x0", "_y0", "_x1", "_y1"), ends, strict=True)))
    cut = geo.clip_segment_to_disc("_x0", "_y0", "_x1", "_y1", "radius_km").alias("_cut")
    return placed.select(*near.columns, "row_no", cut).filter(F.col("_cut").isNotNull())


def runways_in_view(airports: DataFrame, runways: DataFrame, views: DataFrame) -> DataFrame:
    """Runways of the airports near each view, cut to the view's disc, as km offsets from its centre."""
    return _visible(airports_near(airports, views), runways).select("view_id", "ident", "row_no", "_cut.*")


def labelled_airports(airports: DataFrame, runways: DataFrame, views: DataFrame) -> DataFrame:
    """Airports that get a label in a view: near it, with a runway drawn; each once."""
    near = airports_near(airports, views)
    return _visible(near, runways).select(*near.columns).dropDuplicates(["view_id", "ident"])


def distinct_labels(rows: DataFrame) -> DataFrame:
    """One label per view and airport, however many tiles delivered it."""
    return rows.dropDuplicates(["view_id", "ident"])
