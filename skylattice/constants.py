"""Fixed values of the domain: thresholds, tables and formats that results depend on."""

# --- surveillance ---------------------------------------------------------------------------
# Receiver source -> confidence tier; sources not listed are tier 0.
SOURCE_TIERS = {
    "adsb_icao": 3,
    "adsb_icao_nt": 3,
    "adsr_icao": 2,
    "tisb_icao": 2,
    "mlat": 1,
}
KNOWN_SOURCES = (
    "adsb_icao",
    "adsr_icao",
    "adsb_icao_nt",
    "mlat",
    "tisb_icao",
    "tisb_other",
    "tisb_trackfile",
    "adsb_other",
    "mode_s",
    "adsc",
)
EMERGENCY_SQUAWKS = (7500, 7600, 7700)
EMERGENCY_BONUS = 1.0e9
TREND_FPM = 500.0
GROUND_MAX_ALT_FT = 100
GROUND_MAX_SPEED_KT = 40.0

GHOST_MAX_M = 460.0
GHOST_MAX_ALT_FT = 300
GHOST_MAX_TRACK_DEG = 30.0
GHOST_MAX_SPEED_RATIO = 0.30

# (idx, nm, outer_km, tag_budget)
RANGE_PRESETS = (
    (0, 5, 9.26, 20),
    (1, 10, 18.52, 15),
    (2, 15, 27.78, 10),
    (3, 25, 46.3, 6),
)
MAX_TAG_BUDGET = 20
FETCH_SCALE = 118.0 / 107.0
PREDICT_SECONDS = 6.0

RASTER_SIZE = 240
RASTER_CENTER = 120
RASTER_RADIUS = 107

# Focus points used when a device has no valid list of its own: (name, lat, lon, range_idx).
DEFAULT_FOCUS_POINTS = (
    ("KSFO", 37.6188, -122.3750, 2),
    ("KOAK", 37.7213, -122.2214, 2),
)
HOME_POINT = ("Home", 37.7552, -122.4528, 1)
MAX_FOCUS_POINTS = 6
DEFAULT_RANGE_IDX = 1

# --- geodesy --------------------------------------------------------------------------------
NM_PER_DEG = 60.0
KM_PER_DEG = 111.0
M_PER_DEG = 111320.0
KM_PER_NM = 1.852
GEOMAGNETIC_POLE_LAT = 80.65
GEOMAGNETIC_POLE_LON = -72.68
COMPASS_POINTS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")

# --- weather --------------------------------------------------------------------------------
CEILING_COVERS = ("BKN", "OVC", "VV")
CATEGORIES = ("VFR", "MVFR", "IFR", "LIFR")
MAX_VISIBILITY_SM = 10
NEAREST_STATIONS = 32
BBOX_INFLATE = 1.1
HPA_PER_INHG = 33.8639
METAR_TTL_SECONDS = 300
READING_TTL_SECONDS = 900
MIN_PLAUSIBLE_EPOCH = 1704067200  # 2024-01-01T00:00:00Z

# --- airports -------------------------------------------------------------------------------
AIRPORT_TIERS = {"large_airport": 3, "medium_airport": 2, "small_airport": 1}
HELIPAD_MAX_FT = 2500
SEARCH_LIMIT = 8
OVERVIEW_HUBS = 150
MIN_GEOCODE_CHARS = 4
GEOCODE_LIMIT = 5

# --- map tiles ------------------------------------------------------------------------------
# zoom -> Douglas-Peucker tolerance in degrees
ZOOM_TOLERANCES = {3: 0.02, 5: 0.005, 7: 0.0005}
RENDER_ZOOM = 7
OVERVIEW_TOLERANCE = 1.0
MIN_AREA_KM2 = 0.5
TILE_CAP_BYTES = 32768
MAX_SIMPLIFY_TOL = 0.05

TILE_MAGIC = b"PRT1"
TILE_VERSION = 1
#: Of tiles whose counts pass those of version 1; see ``sources.tile_blobs``.
TILE_VERSION_WIDE = 2
WIDE_FLAG = 16
SECTION_KINDS = {"coast": 0, "land": 1, "water": 2, "airports": 3}
HEADER_BYTES = 12
INDEX_ENTRY_BYTES = 12
SECTION_COUNT_BYTES = 2
SHAPE_HEAD_BYTES = 18
POINT_BYTES = 8
AIRPORT_HEAD_BYTES = 18
RUNWAY_BYTES = 16
E7 = 1.0e7

# --- feeds ----------------------------------------------------------------------------------
MAX_TRACK_RADIUS_NM = 250.0
MAX_BOX_LAT_SPAN = 20.0
MAX_BOX_LON_SPAN = 40.0
SESSION_GAP_SECONDS = 30
LATE_SECONDS = 10
POLL_SECONDS = 3
