"""Fixed values the results depend on."""

# Metres per degree of latitude and longitude; both are used as plain constants,
# no projection takes place.
METERS_PER_DEGREE_LAT = 110540.0
METERS_PER_DEGREE_LON = 111320.0

# A buffer polygon is a regular polygon with 16 segments per quadrant.
BUFFER_SIDES = 64

# Mean Gregorian month in seconds (30.436875 days).
SECONDS_PER_MONTH = 30.436875 * 86400

# Feature extraction defaults.
BUFFER_METERS = 500
ROAD_BUFFER_METERS = 10000
BUFFER_SIZES = (250, 500, 1000)
OUTLIER_QUANTILE = 0.95
LIGHTS_NODATA = -999
LIGHTS_MAX_VALID = 1000
DEFAULT_RASTER_YEAR = 2015

# Plausibility limits.
STUDY_BOUNDS = {"min_lat": -5.0, "max_lat": 5.5, "min_lon": 33.5, "max_lon": 42.0}
MAX_POPULATION = 50000
MAX_NIGHT_LIGHTS = 1000

# Rural/urban raster: pixel size, extent (left, right, bottom, top) and shape.
RU_PIXEL_WIDTH = 0.008333
RU_PIXEL_HEIGHT = 0.008340186677631579
RU_EXTENT = (33.91261, 41.91261, -4.670972, 5.470695)
RU_ROWS = 1216
RU_COLUMNS = 960
RU_CLASSES = {float("-inf"): "NA", 0.0: "Peri_Urban", 50.0: "Urban", 100.0: "Rural"}

# Financial service provider categories summed into `fsp`.
FSP_CATEGORIES = (
    "Agricultural",
    "capital_markets",
    "Insuarance",
    "Mobile_Money_agents",
    "Post_Office",
    "bank_agents",
    "development_finance",
    "Microfinance_banks",
    "Money_transer_service",
    "SACCO",
    "commercial_bank",
    "Hire_puchance",
    "Microfinance_Institutions",
    "Pension_Provider",
    "Stand_alone_ATMs",
)

# Degrees to kilometres for the road distance.
KM_PER_DEGREE = 111.32

# Sampling and plot defaults.
SAMPLE_SIZE = 40000
RURAL_SHARE = 0.59
MAX_MONTHS_PLOT = 120
FIRST_CONNECTION_YEAR = 2009

# Variable groups of the panel models.
OUTCOME = "csmo_fact"
CONTINUOUS_VARS = (
    "total_structs",
    "min_dist2_road",
    "fsp",
    "population",
    "Electrification",
    "Night_Lights",
    "GDP",
)
TIME_VARYING_VARS = ("fsp", "population", "Night_Lights", "GDP")
TIME_INVARIANT_VARS = ("Electrification", "total_structs", "min_dist2_road")
DUMMY_SOURCES = (
    "population",
    "total_structs",
    "Electrification",
    "fsp",
    "Night_Lights",
    "min_dist2_road",
)
LOG_VARS = (
    "csmo_fact",
    "min_dist2_road",
    "Night_Lights",
    "population",
    "Electrification",
    "GDP",
    "total_structs",
    "fsp",
)
LOG_CONSTANT = 0.1
DUMMY_CONTROLS = ("Night_Lights", "fsp", "min_dist2_road", "population", "total_structs", "GDP")

# Short dummy names in use -> dummy columns that exist.
DUMMY_ALIASES = {
    "structs_dummy": "total_structs_dummy",
    "NL_dummy": "Night_Lights_dummy",
    "dist2_road_dummy": "min_dist2_road_dummy",
}
DUMMY_VARS = (
    "Electrification_dummy",
    "dist2_road_dummy",
    "population_dummy",
    "structs_dummy",
    "NL_dummy",
    "fsp_dummy",
)
DUMMY_PLOT_ORDER = (
    "fsp_dummy",
    "Electrification_dummy",
    "population_dummy",
    "dist2_road_dummy",
    "structs_dummy",
    "NL_dummy",
)
DUMMY_INTERACTIONS = (
    ("Electrification_dummy", "dist2_road_dummy"),
    ("fsp_dummy", "dist2_road_dummy"),
    ("population_dummy", "structs_dummy"),
)

# Display labels.
VARIABLE_LABELS = {
    "csmo_fact": "Monthly kWh Consumption",
    "total_structs": "Number of Structures",
    "population": "Population Density",
    "fsp": "Financial Service Providers",
    "min_dist2_road": "Distance to Road (km)",
    "Electrification": "Electrification Rate (%)",
    "Night_Lights": "Night-time Illumination",
    "GDP": "GDP per Capita",
    "rural_urban": "Location Type",
    "Year_of_connection": "Year of Connection",
    "Nof_Mths": "Months Since Connection",
}
