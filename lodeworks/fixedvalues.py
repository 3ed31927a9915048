"""Word lists, thresholds and formats that results depend on.

Everything in this module is data that has to hold exactly these values for
results to agree with established practice on the same inputs.
"""

# Rare-earth oxides summed into the total, and pathfinder columns.
RARE_EARTH_OXIDES = [
    "ceo2", "la2o3", "nd2o3", "pr6o11", "sm2o3", "eu2o3", "gd2o3", "dy2o3",
    "y2o3", "er2o3", "yb2o3", "tb4o7", "lu2o3", "ho2o3", "tm2o3",
]
PATHFINDERS = [
    "fe2o3", "p2o5", "al2o3", "sio2", "cao", "mgo", "tho2", "u3o8", "nb2o5",
    "mn", "sr", "ba", "zr", "ti", "k",
]
LIGHT_OXIDES = ["ceo2", "la2o3", "nd2o3", "pr6o11", "sm2o3"]
HEAVY_OXIDES = ["gd2o3", "dy2o3", "y2o3", "er2o3", "yb2o3"]

# Element-form columns used where an assay has no oxides.
LIGHT_ELEMENTS = ["ce", "la", "nd", "pr", "sm", "eu"]
HEAVY_ELEMENTS = ["gd", "tb", "dy", "ho", "er", "yb", "lu", "y"]

# Fixed values: (name, numerator, denominator, constant added to the denominator).
GRADE_RATIOS = [
    ("lree_hree_ratio", "lree", "hree", 0.001),
    ("ce_la_ratio", "ceo2_ppm", "la2o3_ppm", 1.0),
    ("p_fe_ratio", "p2o5_ppm", "fe2o3_ppm", 1.0),
    ("th_u_ratio", "tho2_ppm", "u3o8_ppm", 0.001),
]

# Depth ladders as (upper bound, score) steps, then the last score.
DEPTH_LADDERS = {
    "hole": ([(20, 1.0), (50, 0.95), (100, 0.85), (200, 0.65)], 0.35),
    "matrix": ([(20, 1.0), (50, 0.95), (80, 0.85), (150, 0.65), (300, 0.45)], 0.25),
    "grid": ([(20, 1.0), (50, 0.95), (80, 0.85), (150, 0.65)], 0.35),
}
DEPTH_UNKNOWN = 0.5

# Alteration keywords; the flag form leaves out the last one.
ALTERATION_WORDS = [
    "laterit", "carbonat", "weath", "oxid", "saprolite", "clay", "goethit",
    "limonit", "ferrugin",
]

# Metres per degree, distance floor and centroid scale.
METRES_PER_DEGREE = 111320.0
MIN_DISTANCE_M = 1e-6
CENTROID_SCALE_M = 500.0
RANGE_EPSILON = 1e-9
FALLBACK_P95 = 1000.0

# Column names that reveal the target.
LEAKING_WORDS = ["treo", "lree", "hree", "pseudo_treo", "idw_conf"]
NON_FEATURE_COLUMNS = [
    "lat", "lon", "x", "y", "easting", "northing", "companyholeid", "holeid",
    "hole_id", "datum", "projection", "zone", "company", "holetype", "geom",
    "dataset",
]
LOGGED_TOTALS = ["lree_max", "hree_max", "treo_max"]

# Names recognised as hole id and as coordinates.
HOLE_ID_PRIORITY = ["companyholeid", "companyhole", "holeid", "hole_id", "id"]
HOLE_KEY_PARTS = ["holeid", "collarid"]
LATITUDE_NAMES = ["latitude", "lat", "y_coord", "northing_dd", "lat_dd"]
LONGITUDE_NAMES = ["longitude", "lon", "long", "x_coord", "easting_dd", "lon_dd"]

# Layers and the words that point to them, in order of precedence.
LAYERS = [
    "geophysics", "geochemical", "geology", "satellite", "topography",
    "drillhole", "archive",
]
STRONG_NAME_WORDS = ["collar", "assay", "dh_", "drillhole"]
NAME_WORDS = {
    "geophysics": [
        "tmi", "mag", "magneti", "gravity", "bouguer", "isostatic",
        "radiometri", "gammaray", "gamma_ray", "aeromagnet", "gravimetri",
        "gravi", "emag", "resistiv", "ip_", "induced", "susceptib",
        "conductiv",
    ],
    "geochemical": [
        "geochem", "stream_sed", "soil_", "lithogeochem", "regolith",
    ],
    "drillhole": [
        "collar", "survey", "litholog", "dh_", "drill", "hole", "interval",
        "downhole", "from_to", "assay", "assay_pivot", "lith", "alteration",
        "structure", "element", "ppm", "ppb", "sample",
    ],
    "geology": [
        "geol", "lithol", "formation", "unit", "contact", "fault", "fold",
        "province", "stratigraphy", "map", "outcrop", "rock", "struct",
    ],
    "satellite": [
        "sentinel", "landsat", "aster", "modis", "band", "reflec", "ndvi",
        "swir", "l2a", "l2sp", "surface_ref", "satellite", "imagery", "msil",
        "l1tp",
    ],
    "topography": [
        "dem", "dtm", "dsm", "elevation", "srtm", "lidar", "bathymetry",
        "relief", "slope", "aspect", "topograph", "hillshade", "terrain",
    ],
}
EXTENSION_LAYERS = {
    "geophysics": [
        ".ers", ".grd", ".dat", ".xyz", ".gxf", ".bil", ".hdr", ".nc", ".h5",
        ".hdf", ".tif", ".tiff",
    ],
    "drillhole": [".csv", ".xlsx", ".xls", ".txt", ".accdb", ".mdb"],
    "geology": [
        ".shp", ".gpkg", ".geojson", ".kml", ".kmz", ".gdb", ".e00", ".dxf",
    ],
    "satellite": [".jp2", ".ecw", ".img"],
    "topography": [".asc", ".laz", ".las", ".xyz"],
    "archive": [".zip", ".tar", ".gz", ".7z", ".rar"],
}
HEADER_WORDS = {
    "drillhole": [
        "holeid", "companyholeid", "collar", "fromm", "from_depth",
        "fromdepth", "anumber", "dip", "azimuth", "maxdepth", "easting",
        "northing", "ceo2", "la2o3", "nd2o3", "treo", "lree", "hree", "ppm",
        "ppb",
    ],
    "geochemical": [
        "au", "ag", "cu", "pb", "zn", "mo", "as", "sb", "bi", "w", "sn",
        "element", "result", "value", "units", "detection", "lab",
        "sample_id",
    ],
    "geology": [
        "lithology", "formation", "unit", "description", "rock_type",
        "lith_code", "stratigraph", "age", "period", "epoch",
    ],
    "geophysics": [
        "tmi", "magnetic", "gravity", "radiometric", "uranium", "thorium",
        "potassium", "bouguer", "isostatic", "apparent_resistivity",
    ],
    "topography": [
        "elevation", "height", "z", "altitude", "dem", "dtm", "slope",
        "aspect",
    ],
}
HEADER_EXTENSIONS = [".csv", ".txt"]
IMAGE_EXTENSIONS = [".tif", ".tiff"]

# Deposit names and the words that identify them, in order.
KNOWN_DEPOSITS = {
    "mount_weld": ["mount_weld", "mtweld", "mw_", "weld", "mwgc"],
    "mountain_pass": ["mountain_pass", "mtpass", "moly", "mp_"],
    "bayan_obo": ["bayan", "baiyun", "baotou"],
    "browns_range": ["browns", "brown_range", "br_", "dysprosium"],
    "ngualla": ["ngualla", "peak_rare"],
    "kvanefjeld": ["kvane", "greenland"],
    "lynas": ["lynas", "cld_", "central_lanthan"],
}
UNKNOWN_DEPOSIT = "unknown_deposit"

# Inventory categories by extension.
INVENTORY_CATEGORIES = {
    "tabular": [".csv", ".txt", ".tsv", ".xlsx", ".xls"],
    "gis": [".shp", ".gpkg", ".geojson", ".kml", ".gdb"],
    "raster": [
        ".tif", ".tiff", ".asc", ".grd", ".ers", ".img", ".nc", ".hdf", ".h5",
    ],
    "database": [".db", ".sqlite", ".mdb"],
    "document": [".pdf", ".doc", ".docx"],
    "image": [".jpg", ".jpeg", ".png", ".ecw", ".jp2"],
    "geophys": [".dat", ".xyz", ".gxf"],
    "data": [".json", ".npy", ".pkl", ".parquet"],
    "archive": [".tar", ".zip", ".gz", ".bz2", ".tgz"],
}

# Header words that flag rare-earth columns.
RARE_EARTH_WORDS = [
    "ce", "la", "nd", "pr", "sm", "eu", "treo", "tree", "ree", "lree", "hree",
    "ceo2", "la2o3", "rare earth", "rare_earth",
]

# Retention classes and the extensions a deposit scan accepts.
DELETABLE_EXTENSIONS = [
    ".tif", ".tiff", ".ers", ".img", ".ecw", ".jp2", ".nc", ".hdf", ".h5",
    ".asc", ".grd", ".gxf", ".bil", ".tar", ".zip", ".gz", ".tgz", ".bz2",
]
KEPT_EXTENSIONS = [
    ".csv", ".xlsx", ".xls", ".txt", ".json", ".shp", ".dbf", ".shx", ".prj",
    ".kml", ".geojson",
]
DEPOSIT_EXTENSIONS = [
    ".csv", ".xlsx", ".xls", ".tif", ".tiff", ".shp", ".ers", ".img", ".jp2",
    ".ecw", ".asc", ".xyz", ".json", ".geojson", ".kml", ".zip", ".tar",
]

# Band names by scene family, as (key, upper-case name patterns).
SENTINEL_BANDS = [
    ("s2_blue", ["%\\_B02\\_%", "%B02.JP2"]),
    ("s2_green", ["%\\_B03\\_%", "%B03.JP2"]),
    ("s2_red", ["%\\_B04\\_%", "%B04.JP2"]),
    ("s2_nir", ["%\\_B08\\_%", "%B08.JP2"]),
    ("s2_swir1", ["%\\_B11\\_%", "%B11.JP2"]),
    ("s2_swir2", ["%\\_B12\\_%", "%B12.JP2"]),
]
LANDSAT_BANDS = [
    ("ls_blue", ["%\\_B2.%"]),
    ("ls_green", ["%\\_B3.%"]),
    ("ls_red", ["%\\_B4.%"]),
    ("ls_nir", ["%\\_B5.%"]),
    ("ls_swir1", ["%\\_B6.%"]),
    ("ls_swir2", ["%\\_B7.%"]),
    ("ls_thermal", ["%ST\\_B10%"]),
]

# Surface bands, marker bands and report sizes.
SURFACE_LEVELS = [0.4, 0.6, 0.75, 0.85]
TOP_TARGETS = 50
NEIGHBOURS = 8
COOLDOWN_SECONDS = 120
