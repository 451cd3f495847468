"""Top products per area."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.text import concat_long_string, json_field
from visitlens.operators.topk import top_per_group
from visitlens.params import TaskParams
from visitlens.schemas import CITY_INFO, PRODUCT_INFO, require
from visitlens.sources.tables import clicks_in_range

# Area levels; any other area is OTHER_LEVEL.
AREA_LEVELS: Mapping[str, Sequence[str]] = {
    "A Level": ("China North", "China East"),
    "B Level": ("China South", "China Middle"),
    "C Level": ("West North", "West South"),
}
OTHER_LEVEL = "D Level"


def area_level(area: Column | str, levels: Mapping[str, Sequence[str]] = AREA_LEVELS) -> Column:
    column = F.col(area) if isinstance(area, str) else area
    level = F.lit(OTHER_LEVEL)
    for name, areas in levels.items():
        level = F.when(column.isin(list(areas)), name).otherwise(level)
    return level


def product_status(extend_info: Column | str) -> Column:
    """``Self`` for status 0, ``Third Party`` for everything else, unreadable JSON included."""
    return F.when(json_field(extend_info, "product_status") == "0", "Self").otherwise("Third Party")


def click_product_basic(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks with the name and area of their city; clicks of unknown cities are left out."""
    require(cities, CITY_INFO)
    return clicks.join(cities, "city_id").select("city_id", "city_name", "area", "product_id")


def area_product_click_count(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks per area and product, with the sorted list of ``city_id:city_name``.

    Clicks are first counted per city and product: that shuffle carries one row per pair and
    task however popular a product is, and everything after it works on the counts.
    """
    require(cities, CITY_INFO)
    per_city = clicks.groupBy("city_id", "product_id").agg(F.count(F.lit(1)).alias("click_count"))
    labelled = per_city.join(cities, "city_id").select(
        "area", "product_id", "click_count", concat_long_string("city_id", "city_name", ":").alias("city_label")
    )
    # The list holds at most the cities of one area.
    return labelled.groupBy("area", "product_id").agg(
        F.sum("click_count").alias("click_count"),
        F.array_join(F.array_sort(F.collect_set("city_label")), ",").alias("city_infos"),
    )


def area_product_full(counts: DataFrame, products: DataFrame) -> DataFrame:
    """Counts with product name and status; unknown products are left out."""
    require(products, PRODUCT_INFO)
    described = products.select("product_id", "product_name", product_status("extend_info").alias("product_status"))
    return counts.join(described, "product_id").select(
        "area", "product_id", "click_count", "city_infos", "product_name", "product_status"
    )


def top_products_per_area(
    full: DataFrame, n: int = 3, levels: Mapping[str, Sequence[str]] = AREA_LEVELS
) -> DataFrame:
    ranked = top_per_group(full, ["area"], [F.desc("click_count"), F.asc("product_id")], n, unique="product_id")
    return ranked.select(
        "area",
        area_level("area", levels).alias("area_level"),
        "product_id",
        "click_count",
        "city_infos",
        "product_name",
        "product_status",
    )


def area_top_products(
    actions: DataFrame,
    cities: DataFrame,
    products: DataFrame,
    params: TaskParams,
    n: int = 3,
    levels: Mapping[str, Sequence[str]] = AREA_LEVELS,
) -> DataFrame:
    """The ``n`` most clicked products of each area in the date range."""
    counts = area_product_click_count(clicks_in_range(actions, params), cities)
    return top_products_per_area(area_product_full(counts, products), n, levels)
