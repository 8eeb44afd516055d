"""Small fixed tables: trade synonyms, editorial affinity weights, map-tag names, class names.

All of them are bounded by this file, so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Words a user types and the stored categories they stand for.
CATEGORY_SYNONYMS: dict[str, list[str]] = {
    "bakery": ["bakery"],
    "bakeries": ["bakery"],
    "pharmacy": ["pharmacy"],
    "pharmacies": ["pharmacy"],
    "cafe": ["cafe"],
    "coffee": ["cafe"],
    "restaurant": ["restaurant"],
    "restaurants": ["restaurant"],
    "supermarket": ["supermarket"],
    "gym": ["gym"],
    "dentist": ["dentist"],
    "dentists": ["dentist"],
    "hair salon": ["hair_salon"],
    "hair salons": ["hair_salon"],
    "hairdresser": ["hair_salon"],
    "hotel": ["hotel"],
    "hotels": ["hotel"],
    "food and drink": ["restaurant", "cafe", "bakery"],
    "food & drink": ["restaurant", "cafe", "bakery"],
}

# Editorial complementarity weights, target trade -> neighbouring trade -> weight.
AFFINITY: dict[str, dict[str, float]] = {
    "bakery": {
        "elementary_school": 0.8, "kindergarten": 0.8, "supermarket": 0.6, "cafe": 0.5,
        "coffee_shop": 0.5, "park": 0.5, "pharmacy": 0.4,
    },
    "cafe": {
        "art_gallery": 1.0, "hair_salon": 0.9, "beauty_salon": 0.8, "gym": 0.8, "hotel": 0.7,
        "park": 0.7, "clothing_store": 0.6, "bar": 0.4,
    },
    "coffee_shop": {
        "art_gallery": 1.0, "hair_salon": 0.9, "beauty_salon": 0.8, "gym": 0.8, "hotel": 0.7,
        "park": 0.7, "clothing_store": 0.6, "bar": 0.4,
    },
    "pharmacy": {
        "doctor": 1.0, "dentist": 0.9, "physical_therapy": 0.8, "supermarket": 0.6,
        "elementary_school": 0.4,
    },
    "restaurant": {
        "hotel": 0.9, "bar": 0.8, "landmark_and_historical_building": 0.7, "art_gallery": 0.6,
    },
    "supermarket": {"pharmacy": 0.6, "bakery": 0.5, "gas_station": 0.5, "bank_credit_union": 0.4},
    "gym": {
        "sports_club_and_league": 0.9, "physical_therapy": 0.9, "beauty_salon": 0.7, "cafe": 0.5,
        "coffee_shop": 0.5,
    },
    "kindergarten": {"elementary_school": 0.9, "park": 0.8, "pharmacy": 0.5, "bakery": 0.5},
    "dentist": {
        "doctor": 0.9, "pharmacy": 0.8, "physical_therapy": 0.6, "beauty_salon": 0.3,
        "supermarket": 0.3,
    },
    "hair_salon": {
        "beauty_salon": 0.7, "nail_salon": 0.7, "clothing_store": 0.6, "cafe": 0.5,
        "coffee_shop": 0.5, "gym": 0.4,
    },
    "hotel": {
        "landmark_and_historical_building": 0.9, "restaurant": 0.8, "bar": 0.7, "cafe": 0.6,
        "coffee_shop": 0.6,
    },
}

# Stored category -> map tag whose monthly history stands for it.
HISTORY_TAGS: dict[str, str] = {
    "bakery": "shop=bakery",
    "cafe": "amenity=cafe",
    "coffee_shop": "amenity=cafe",
    "restaurant": "amenity=restaurant",
    "bar": "amenity=bar",
    "supermarket": "shop=supermarket",
    "pharmacy": "amenity=pharmacy",
    "gym": "leisure=fitness_centre",
    "hair_salon": "shop=hairdresser",
    "clothing_store": "shop=clothes",
    "hotel": "tourism=hotel",
    "ev_charging_station": "amenity=charging_station",
    "kindergarten": "amenity=kindergarten",
    "elementary_school": "amenity=school",
    "art_gallery": "tourism=gallery",
    "doctor": "amenity=doctors",
    "dentist": "amenity=dentist",
    "bank_credit_union": "amenity=bank",
}

# Segment classes counted as drivable roads and as walkways.
ROAD_CLASSES = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "residential", "living_street",
    "unclassified", "service",
)
WALK_CLASSES = ("footway", "path", "pedestrian", "cycleway", "steps", "track")


def resolve_categories(word: str) -> list[str]:
    """A typed trade word to stored categories; an unknown word stands for itself."""
    key = word.strip().lower()
    return list(CATEGORY_SYNONYMS.get(key, [key]))


def synonyms_table(spark: SparkSession) -> DataFrame:
    rows = [(w, i, c) for w, cats in CATEGORY_SYNONYMS.items() for i, c in enumerate(cats)]
    return spark.createDataFrame(rows, "word string, position int, category string")


def affinity_table(spark: SparkSession) -> DataFrame:
    """The editorial matrix. An opinion shown next to a pick, never part of its score."""
    rows = [(t, n, w) for t, ns in AFFINITY.items() for n, w in ns.items()]
    return spark.createDataFrame(rows, "target string, neighbor string, weight double")


def history_tags_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HISTORY_TAGS.items()), "category string, tag string")
