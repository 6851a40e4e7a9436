"""Synthetic streams: the same rows for the same arguments, whatever the partitioning.

Pseudo-random choices are arithmetic on the row number (a linear congruence), so any engine can make the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.functions.columns import div
from brooklet.operators.ordered import numbered


def draw(n: Column, salt: int, choices: int) -> Column:
    """A choice of 0 to ``choices`` - 1 for each row number."""
    return F.pmod(F.pmod(n * 7919 + salt * 104729, F.lit(1_000_003)) * 31 + salt, F.lit(choices))


def auction(spark: SparkSession, calls: int) -> dict[str, DataFrame]:
    """Persons, items and bids of an auction: 50 + calls / 10 persons, 50 + calls items, 10 bids a call."""
    n = F.col("id")
    people = 50 + calls // 10
    items = 50 + calls
    persons = spark.range(people).select(n.alias("person_id"), F.concat(F.lit("person"), n).alias("name"), F.concat(F.lit("mailto:p"), n, F.lit("@example.org")).alias("emailaddress"))
    auctions = spark.range(items).select(n.alias("auction_id"), draw(n, 1, people).alias("seller"), draw(n, 2, 20).alias("category"), (draw(n, 3, 10) + 1).alias("quantity"), (n * 1000).alias("start_time"), (n * 1000 + 60_000 + draw(n, 4, 60_000)).alias("end_time"))
    # Cubing a uniform draw makes few auctions take most bids.
    skewed = F.floor(F.pow(draw(n, 5, 10_000) / 10_000.0, 3) * items).cast("long")
    bids = spark.range(10 * calls).select(n.alias("bid_id"), skewed.alias("auction_id"), draw(n, 6, people).alias("person_ref"), (draw(n, 7, 500) + 1).alias("bid"), (n * 100).alias("time"))
    return {"person": persons, "open_auction": auctions, "bid": bids}


def traffic(spark: SparkSession, segments: int = 9, detectors: int = 40, reports: int = 3240, start: int = 1_205_560_800_000, step: int = 20_000) -> DataFrame:
    """Detector reports: every ``step`` ms, speed 5 to 64 with 0 in about 6 of 100 rows, volume 0 to 9, occupancy 10 to 99."""
    n = F.col("id")
    per = segments * detectors
    speed = F.when(draw(n, 11, 100) < 6, 0).otherwise(draw(n, 12, 60) + 5)
    at = F.floor(n / per)
    return spark.range(per * reports).select((F.lit(start) + at * step).alias("time_t"), (n % per).alias("detector_id"), F.floor((n % per) / detectors).alias("segment_id"), draw(n, 13, 10).alias("volume"), speed.alias("speed"), (draw(n, 14, 90) + 10).alias("occupancy"))


def temperature(spark: SparkSession, rows: int, stations: int = 10) -> DataFrame:
    """Temperature readings of stations, a minute apart."""
    n = F.col("id")
    return spark.range(rows).select((F.floor(n / stations) * 60_000).alias("time"), (n % stations).alias("station"), (draw(n, 21, 400) - 100).alias("tenths"))


def packets(spark: SparkSession, rows: int) -> DataFrame:
    """Packet headers with a few hosts that send most."""
    n = F.col("id")
    host = lambda salt: F.concat(F.lit("10.0.0."), F.floor(F.pow(draw(n, salt, 1000) / 1000.0, 2) * 250).cast("long"))
    return spark.range(rows).select((n * 10).alias("time"), host(31).alias("source"), host(32).alias("dest"), F.element_at(F.array(F.lit("tcp"), F.lit("udp"), F.lit("icmp")), (draw(n, 33, 3) + 1).cast("int")).alias("protocol"), (draw(n, 34, 1460) + 40).alias("size"))


def parts_of_file(spark: SparkSession, path: str, row_tag: str, schema: T.StructType, order: str, by: Column, rows: int) -> DataFrame:
    """The elements of an XML file over and over, by their ``order`` (``by``: see ``ordered``), until there are so many ``rows``; ``n`` numbers them from 0."""
    held = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    parts, count = numbered(held, [], order, by, "_no").withColumn("_no", F.col("_no") - 1), held.count()
    turns = F.explode(F.sequence(F.lit(0), div(F.lit(rows - 1) - F.col("_no"), max(count, 1))))
    return parts.filter(F.col("_no") < rows).withColumn("_turn", turns).withColumn("n", F.col("_turn") * count + F.col("_no")).drop("_no", "_turn")


def declared_documents(spark: SparkSession, rows: int, root: str, elements: dict[str, list[str]], depth: int = 6, most: int = 3) -> DataFrame:
    """XML documents that keep to element declarations, a row each: n and xml.

    ``elements`` names each element's children in order, with ``?`` (none or one), ``*`` (none to ``most``) or ``+`` (one to ``most``) behind those that
    don't come exactly once; an element without an entry holds a number. Below ``depth`` levels only children that must come are made.
    """
    salt = iter(range(41, 1 << 30))

    def made(tag: str, level: int) -> Column:
        inner = []
        for child in elements.get(tag, []):
            name, mark = child.rstrip("?*+"), child[-1]
            least, largest = {"?": (0, 1), "*": (0, most), "+": (1, most)}.get(mark, (1, 1))
            largest = largest if level < depth else least
            if level > 4 * depth:
                raise ValueError(f"{name} must contain itself")
            count = draw(F.col("id"), next(salt), largest - least + 1) + least
            inner += [made(name, level + 1) if k < least else F.when(count > k, made(name, level + 1)).otherwise("") for k in range(largest)]
        held = inner if tag in elements else [draw(F.col("id"), next(salt), 1000).cast("string")]
        return F.concat(F.lit(f"<{tag}>"), *held, F.lit(f"</{tag}>"))

    return spark.range(rows).select(F.col("id").alias("n"), made(root, 0).alias("xml"))


def rate_source(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """A stream that is throttled at its source."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
