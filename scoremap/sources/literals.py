"""Small fixed tables: sites, palette, indicator weights and indicator scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# They must be these for right results.
SITES = [
    # ordinal, name, lat, lon, video, video_id, start_s, end_s
    (0, "Elmhurst, Queens", 40.738536, -73.887267, "elmhurst_deployment.mp4", "o52MZ1AHyjA", 44, 62),
    (1, "Sutton Place, Manhattan", 40.758890, -73.958457, "sutton_place_deployment.mp4", "o52MZ1AHyjA", 21, 43),
    (2, "Herald Square, Manhattan", 40.748422, -73.988275, "herald_square_deployment.mp4", "o52MZ1AHyjA", 63, 83),
    (3, "Jackson Heights, Queens", 40.747379, -73.889690, "jackson_heights_deployment.mp4", "o52MZ1AHyjA", 85, 100),
]
SITE_SCHEMA = "ordinal int, name string, lat double, lon double, video string, video_id string, start_s int, end_s int"

# Red to green.
PALETTE = [
    (165, 0, 38),
    (215, 48, 39),
    (244, 109, 67),
    (253, 174, 97),
    (254, 224, 144),
    (255, 255, 191),
    (217, 239, 139),
    (166, 217, 106),
    (102, 189, 99),
    (26, 152, 80),
    (0, 104, 55),
]

# Published weights.
WEIGHTS = [
    ("Pedestrian Density", "11.1%"),
    ("Crowd Dynamics", "8.4%"),
    ("Pedestrian Flow", "8.1%"),
    ("Sidewalk Quality", "6.6%"),
    ("Street Width", "6.2%"),
    ("Density of Street Furniture", "5.9%"),
]

# Published ordinal scales.
SCALES = [
    ("Sidewalk width", "0 = narrow, 1 = wide"),
    ("Pedestrian density", "0 = high density, 1 = low density"),
    ("Density of street furniture (e.g. garbage, poles)", "0 = high density, 1 = moderate density, 2 = low density, 3 = no furniture"),
    ("Sidewalk / Surface roughness", "0 = gravel, 1 = cobblestones, 2 = smooth asphalt"),
    ("Surface condition", "0 = potholes, 1 = major cracks, 2 = minor cracks, 3 = smooth"),
    ("Wireless communication infrastructure", "0 = no infrastructure, 1 = basic Wi-Fi, 2 = 5G, IoT"),
    ("Slope gradient", "0 = high slope, 1 = no slope"),
    ("Presence of charging stations", "0 = no charging stations nearby, 1 = multiple charging stations in proximity"),
    ("Local attitudes towards robots", "0 = highly negative, 1 = somewhat negative, 2 = neutral, 3 = somewhat positive, 4 = highly positive"),
    ("Curb ramp availability", "0 = no curb ramps, 1 = curb ramps at some intersections, 2 = curb ramps at most intersections, 3 = curb ramps with tactile paving"),
    ("Weather conditions", "0 = ice, 1 = snow, 2 = puddles, 3 = leaves, 4 = clear"),
    ("Crowd dynamics", "0 = emergency, 1 = commuting, 2 = shopping, 3 = leisure"),
    ("Traffic management", "0 = no system, 1 = basic signage, 2 = street lights, 3 = advanced traffic control"),
    ("Surveillance coverage (CCTV)", "0 = no coverage, 1 = low coverage, 2 = moderate coverage, 3 = high coverage"),
    ("Zoning laws and regulation", "0 = no regulations, 1 = moderate stringency, 2 = high stringency"),
    ("Bike lane availability", "0 = no bike lanes, 1 = bike lanes on most roads, 2 = separated bike lanes on all roads"),
    ("Street lighting", "0 = no lighting, 1 = excellent lighting"),
    ("Existence of shade", "0 = no shade, 1 = extensive shade"),
    ("GPS signal strength", "0 = no signal, 1 = very strong signal"),
    ("Pedestrian flow", "0 = very high flow, 1 = very low flow"),
    ("Bicycle traffic", "0 = very high traffic, 1 = very low traffic"),
    ("Vehicle traffic", "0 = very high traffic, 1 = very low traffic"),
    ("Existence of detailed digital maps", "0 = no digital maps, 1 = highly detailed maps"),
    ("Intersection safety", "0 = no infrastructure, 1 = basic crosswalks, 2 = zebra crossings with signals, 3 = advanced intersection management"),
]

BOROUGHS = ["Manhattan", "Queens", "Brooklyn", "Bronx", "Staten Island"]


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITES, SITE_SCHEMA)


def weights(spark: SparkSession) -> DataFrame:
    """``indicator, weight`` with the weight as a share of 1."""
    return spark.createDataFrame([(n, float(w.rstrip("%")) / 100) for n, w in WEIGHTS], "indicator string, weight double")


def scales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SCALES)], "ordinal int, indicator string, scale string")
