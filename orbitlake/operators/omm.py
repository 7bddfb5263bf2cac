"""Orbit mean-element messages from element rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of a message file, in order.
OMM_FIELDS = (
    "OBJECT_NAME", "OBJECT_ID", "EPOCH", "MEAN_MOTION", "ECCENTRICITY", "INCLINATION", "RA_OF_ASC_NODE", "ARG_OF_PERICENTER", "MEAN_ANOMALY",
    "EPHEMERIS_TYPE", "CLASSIFICATION_TYPE", "NORAD_CAT_ID", "ELEMENT_SET_NO", "REV_AT_EPOCH", "BSTAR", "MEAN_MOTION_DOT", "MEAN_MOTION_DDOT",
)


def with_name(sets: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """With object_name from the metadata, or the object_id where there is none."""
    m = metadata.select(key, F.col("object_name").alias("_name"))
    return sets.join(m, key, "left").withColumn("object_name", F.coalesce("_name", "object_id")).drop("_name")


def omm(sets: DataFrame) -> DataFrame:
    """Message fields of element rows that have a name and an id."""
    c = F.col
    values = (
        c("object_name"), c("object_id"), F.date_format("epoch", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), c("mm"), c("ecc"), c("inc"), c("raan"), c("aop"), c("ma"),
        F.lit(0), F.lit("U"), c("norad"), c("elnum"), c("revnum"), c("bstar"), c("ndot"), c("nddot"),
    )
    return sets.select(*(v.alias(n) for v, n in zip(values, OMM_FIELDS, strict=True)))
