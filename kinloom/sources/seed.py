"""A small graph to start from: invented people of an invented land."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import RESULT

DYNASTIES = [("dynasty_vale", "Vale", "Orrin Vale", "Harth", 901, 934), ("dynasty_marsh", "Marsh", "Tamsin Reed", "Lowmere", 934, 960), ("dynasty_ember", "Ember", "Nobody Known", None, 960, None)]
PLACES = [("place_harth", "Harth", None), ("place_lowmere", "Lowmere", "New Lowmere"), ("place_ford", "Stone Ford", None)]
PERSONS = [
    ("person_orrin", "Orrin Vale", ["The Miller", "Orrin the Old"], "king", ["Vale"], 860, 921), ("person_ilse", "Ilse Vale", ["Ilse of Harth"], "queen", ["Vale"], 885, 930), ("person_bram", "Bram Vale", [], "general", ["Vale", "Marsh"], None, 941),
    ("person_tamsin", "Tamsin Reed", ["The Reed"], "king", ["Marsh"], 899, 955), ("person_corin", "Corin Ash", ["Little Ash"], "minister", ["Marsh"], None, None), ("person_corin_young", "Little Ash", ["Ash the Scribe"], "其他", ["Ember"], 920, None),
]
EVENTS = [("event_ford", "Battle of Stone Ford", "battle", 919, "Stone Ford", ["Orrin Vale", "Bram Vale"]), ("event_crown", "Crowning at Lowmere", "rite", 934, "Lowmere", ["The Reed", "Corin Ash", "A Stranger"]), ("event_burial", "Burial of Bram", "rite", 941, None, ["Ash the Scribe"])]
RELATIONS = [("Orrin Vale", "Ilse Vale", "FATHER_OF", None), ("Orrin Vale", "Bram Vale", "ADOPTED_SON", 905), ("The Reed", "Ilse Vale", "REPLACED", 934), ("Little Ash", "Tamsin Reed", "served", None), ("Bram Vale", "Lowmere", "fled to", 935), ("Bram Vale", "Nowhere", "FLED_TO", 936)]


def seed_result(spark: SparkSession) -> DataFrame:
    """The seed rows as one extraction result (seq, result)."""
    found = {
        "dynasties": [dict(zip(("uid", "name", "founder", "capital", "start_year", "end_year"), x, strict=True)) | {"description": ""} for x in DYNASTIES],
        "places": [dict(zip(("uid", "name", "modern_name"), x, strict=True)) | {"description": ""} for x in PLACES],
        "persons": [dict(zip(("uid", "original_name", "aliases", "role", "loyalty", "birth_year", "death_year"), x, strict=True)) | {"description": ""} for x in PERSONS],
        "events": [dict(zip(("uid", "name", "event_type", "year", "location", "participants"), x, strict=True)) | {"description": ""} for x in EVENTS],
        "relations": [dict(zip(("source", "target", "relation_type", "year"), x, strict=True)) | {"description": ""} for x in RELATIONS],
    }
    rows = spark.createDataFrame([(0, json.dumps(found, ensure_ascii=False))], "seq long, j string")
    return rows.select("seq", F.from_json("j", RESULT).alias("result"))
