"""End-to-end jobs over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice import constants as C
from skylattice.operators import airports as A
from skylattice.operators import surveillance as S
from skylattice.operators import tilepyramid as P
from skylattice.operators import timeline
from skylattice.operators import weather as W
from skylattice.sinks import writers
from skylattice.session import materialize
from skylattice.sources import readers, tile_blobs


def radar_labels(raw_tracks: DataFrame, views: DataFrame) -> DataFrame:
    """Raw feed rows to the labelled tracks of every view (slot, lat, lon, range_idx, outer_km, tag_budget)."""
    tracks = S.ghost_dedup(S.clean_tracks(raw_tracks))
    largest = views.agg(F.max("tag_budget")).head()[0] or 0
    return S.tag_ranking(S.range_class(S.tracks_in_radius(tracks, views)), max_budget=int(largest))


def weather_board(raw_metar: DataFrame, views: DataFrame, *, k: int = C.NEAREST_STATIONS) -> DataFrame:
    """Raw reports to the nearest stations of every view, each with its newest report only."""
    # Of several reports of one poll the last in the last document counts.
    ties = [c for c in ("document_id", "feed_pos") if c in raw_metar.columns]
    newest = timeline.latest_per_key(W.stations(raw_metar), keys=["icao"], order=["fetched_at", *ties])
    return W.nearest_k_stations(newest, views, k=k)


def bake(
    spark: SparkSession,
    *,
    land: DataFrame,
    water: DataFrame,
    rivers: DataFrame,
    csv_folder: str,
    out_folder: str,
    cap: int = C.TILE_CAP_BYTES,
    least_tiles: int | None = None,
) -> DataFrame:
    """Map features and airport CSVs to a tile table, tile files and an airport index; returns the cap actions.

    Tiles that the binary format cannot hold are listed with their reason under ``rejected``. With
    ``least_tiles`` the shapes are counted in the pass that writes them, and a pyramid that lacks tiles or
    zooms, or whose coarser zooms are not smaller, fails the job before any tile file appears.
    """
    tables = readers.read_airport_csvs(spark, csv_folder)
    for name, table in tables.items():
        tables[name], rejected = readers.split_corrupt(table)
        writers.write_quarantine(rejected.withColumn("source", F.lit(name)), f"{out_folder}/rejected_rows/{name}", mode="overwrite")
    approach = A.approach_idents(tables["runways"], tables["navaids"])
    airports = A.build_airports(tables["airports"], tables["runways"], approach)
    land = P.filter_by_area(land)
    features = (
        land.unionByName(P.filter_by_area(water)).unionByName(P.rings_to_lines(land)).unionByName(rivers)
    )
    shapes, tiles = P.build_tile_pyramid(features, airports, cap=cap)
    shapes, seen = P.watched(shapes)
    writers.write_tile_table(shapes, f"{out_folder}/shapes")
    shapes = writers.read_tile_table(spark, f"{out_folder}/shapes").select(*shapes.columns)
    if least_tiles is not None:
        P.require_whole(seen.get, tiles.count(), C.ZOOM_TOLERANCES, least_tiles)
    nested = A.nest_runways(airports, A.airport_runways(tables["runways"]))
    blobs = materialize(tile_blobs.encode_tiles(shapes, P.airport_tiles(nested)))
    writers.write_tile_blobs(blobs, out_folder, mode="overwrite")
    writers.write_quarantine(blobs.filter(F.col("reason").isNotNull()).drop("payload", "bytes"), f"{out_folder}/rejected")
    writers.write_airport_index(A.airport_index(tables["airports"], tables["runways"], tables["navaids"]), f"{out_folder}/index")
    return P.cap_actions(tiles)
