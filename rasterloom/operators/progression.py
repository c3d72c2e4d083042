"""Packet orders: the five progressions, and the union of progression changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sort keys of packets (layer, res, comp, precinct, ref_x, ref_y) on the decoder's side.
ORDERS = {
    "lrcp": ("layer", "res", "comp", "precinct"),
    "rlcp": ("res", "layer", "comp", "precinct"),
    "rpcl": ("res", "ref_y", "ref_x", "comp", "precinct", "layer"),
    "pcrl": ("ref_y", "ref_x", "comp", "res", "precinct", "layer"),
    "cprl": ("comp", "ref_y", "ref_x", "res", "precinct", "layer"),
}
#: The encoder sorts by the precinct's index instead of its place.
PACKET_ORDERS = {
    "lrcp": ("layer", "res", "comp", "precinct"),
    "rlcp": ("res", "layer", "comp", "precinct"),
    "rpcl": ("res", "precinct", "comp", "layer"),
    "pcrl": ("precinct", "comp", "res", "layer"),
    "cprl": ("comp", "precinct", "res", "layer"),
}


def packets(precincts: DataFrame, layers: int) -> DataFrame:
    return precincts.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))))


def ordered(df: DataFrame, order: str, *keys: str, encoder: bool = False) -> DataFrame:
    """Adds each packet's place (ord) within its tile."""
    by = (PACKET_ORDERS if encoder else ORDERS)[order]
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1)


def union_of_changes(volumes: DataFrame, *keys: str) -> DataFrame:
    """Each packet once, where the first volume (column volume, then ord) has it."""
    packet = [*keys, "layer", "res", "comp", "precinct"]
    first = Window.partitionBy(*packet).orderBy("volume", "ord")
    kept = volumes.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("volume", "ord")) - 1)
