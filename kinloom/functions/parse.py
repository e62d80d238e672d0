"""Lenient reading of language-model output: thoughts, fences and prose around the JSON are dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

PERSON = "struct<uid:string,original_name:string,aliases:array<string>,role:string,loyalty:array<string>,birth_year:int,death_year:int,death_cause:string,description:string>"
DYNASTY = "struct<uid:string,name:string,founder:string,capital:string,start_year:int,end_year:int,description:string>"
EVENT = "struct<uid:string,name:string,event_type:string,year:int,location:string,participants:array<string>,outcome:string,description:string>"
PLACE = "struct<uid:string,name:string,modern_name:string,description:string>"
RELATION = "struct<source:string,target:string,relation_type:string,year:int,description:string>"
EXTRACTION = f"struct<persons:array<{PERSON}>,dynasties:array<{DYNASTY}>,events:array<{EVENT}>,places:array<{PLACE}>,relations:array<{RELATION}>,source_text:string,source_chapter:string>"


def without_thoughts(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))


def _valid(text: Column) -> Column:
    """The text if it is JSON, else null."""
    return F.when(F.try_parse_json(F.nullif(strip(text), F.lit(""))).isNotNull(), text)


def json_text(output: Column) -> Column:
    """The JSON in a model's output: all of it, a fenced block, or what the outermost braces hold; else null."""
    text = without_thoughts(output)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(_valid(text), _valid(fenced), _valid(braces))


def extraction(output: Column) -> Column:
    return F.from_json(json_text(output), EXTRACTION)


def query_text(output: Column) -> Column:
    """The SQL in a model's output: a fenced block, else what follows the first SELECT or WITH; else null."""
    text = without_thoughts(output)
    fenced = strip(F.regexp_extract(text, r"(?is)```(?:sql)?\s*(.*?)```", 1))
    found = strip(F.regexp_extract(text, r"(?is)\b(?:select|with)\b.*", 0))
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(found, F.lit("")))
