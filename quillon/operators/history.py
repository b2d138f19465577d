"""History of changing entity attributes: versions and the period for which each held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import table

_TIME = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)\s*(?:[Zz]|([+-]\d{2}):?(\d{2}))?$"


def instant_us(text: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO 8601 date and time; without a zone it is UTC. Null for anything else, such as a date alone."""
    t = F.trim(text)
    g = [F.regexp_extract(t, _TIME, i) for i in range(1, 5)]
    zone = F.when(g[2] == "", F.lit("+00:00")).otherwise(F.concat(g[2], F.lit(":"), g[3]))
    return F.when(t.rlike(_TIME), F.unix_micros(F.concat(g[0], F.lit(" "), g[1], zone).try_cast("timestamp")))


def latest_at_instant(updates: DataFrame, entity: str, at: Column, attributes: dict[str, Column], received: list[str]) -> DataFrame:
    """(entity, at, s): of several updates of an entity at one instant, the attributes s of the last received."""
    return (
        updates.select(F.col(entity).alias("entity"), at.alias("at"), F.struct(*[c.alias(n) for n, c in attributes.items()]).alias("s"), F.struct(*received).alias("received"))
        .where("entity IS NOT NULL AND at IS NOT NULL")
        .groupBy("entity", "at").agg(F.max_by("s", F.struct("received", "s")).alias("s"))
    )


def _fold(instants: DataFrame, *keys: str) -> DataFrame:
    """One sorted array of structs for each key, folded so that an element is added only when the attributes change."""
    ordered = instants.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("u"))

    def step(versions: Column, u: Column) -> Column:
        return F.when((F.size(versions) > 0) & F.element_at(versions, -1)["s"].eqNullSafe(u["s"]), versions).otherwise(F.concat(versions, F.array(u)))

    return ordered.select(*keys, F.aggregate("u", F.slice("u", 1, 1), step).alias("v"))


def versions(updates: DataFrame, entity: str, at: Column, attributes: dict[str, Column], received: list[str], chunk_rows: int = 2_000) -> DataFrame:
    """(entity, version_no, valid_from_us, valid_to_us, <attributes>): each longest stretch of an entity's updates, by instant, with the same attributes.

    valid_to_us is where the next version begins, null for the last. Nulls among the attributes are equal to each other. Updates without
    entity or instant are left out; of updates at one instant the last received counts, so repeated rows change nothing. An empty input gives no rows.
    An entity with more than chunk_rows instants is cut into chunks that follow each other in time; the chunks are folded
    apart and joined by their first and last versions, so that no task holds a whole large entity.
    """
    instants = table(latest_at_instant(updates, entity, at, attributes, received), "instants")
    large = table(instants.groupBy("entity").count().where(F.col("count") > chunk_rows), "large-entities")
    v = F.posexplode("v").alias("i", "x")

    def out(df: DataFrame) -> DataFrame:
        return df.select("entity", "version_no", F.col("x.at").alias("valid_from_us"), "valid_to_us", *[F.col(f"x.s.{n}").alias(n) for n in attributes])

    small = instants if large.isEmpty() else instants.join(large, "entity", "left_anti")
    folded = _fold(small, "entity").select("entity", "v", v)
    result = out(folded.select("entity", "x", (F.col("i") + 1).alias("version_no"), F.try_element_at("v", F.col("i") + 2)["at"].alias("valid_to_us")))
    if large.isEmpty():
        return result

    n = max(int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions")), large.agg(F.sum("count")).first()[0] // 200_000 + 1)
    placed = instants.join(large.select("entity"), "entity", "left_semi").repartitionByRange(n, "entity", "at").sortWithinPartitions("entity", "at")
    placed = table(placed.withColumn("chunk", F.expr(f"shiftright(monotonically_increasing_id(), 33) * 10000000 + (monotonically_increasing_id() & 8589934591) div {chunk_rows}")), "chunks")
    chunks = table(_fold(placed, "entity", "chunk"), "folded")
    w = Window.partitionBy("entity").orderBy("from")
    ends = chunks.select("entity", "chunk", F.col("v")[0]["at"].alias("from"), F.col("v")[0]["s"].alias("s0"), F.element_at("v", -1)["s"].alias("s1"), F.size("v").alias("n"))
    ends = ends.withColumn("goes_on", F.lag("s1").over(w).eqNullSafe(F.col("s0")) & F.lag("n").over(w).isNotNull())
    ends = ends.withColumn("own", F.col("n") - F.col("goes_on").cast("int"))
    ends = ends.withColumn("before", F.sum("own").over(w) - F.col("own"))
    # the next version's begin: in a later chunk, the first one that brings something new
    begins = F.when(~F.col("goes_on"), F.col("from"))
    second = chunks.select("entity", "chunk", F.try_element_at("v", F.lit(2))["at"].alias("second"))
    ends = ends.join(second, ["entity", "chunk"]).withColumn("next", F.min(F.coalesce(begins, "second")).over(w.rowsBetween(1, Window.unboundedFollowing)))
    parts = chunks.join(ends.select("entity", "chunk", "goes_on", "before", "next"), ["entity", "chunk"]).select("entity", "goes_on", "before", "next", "v", v)
    parts = parts.where(~(F.col("goes_on") & (F.col("i") == 0)))
    number = (F.col("before") + F.col("i") + 1 - F.col("goes_on").cast("int")).cast("int")
    return result.union(out(parts.select("entity", "x", number.alias("version_no"), F.coalesce(F.try_element_at("v", F.col("i") + 2)["at"], F.col("next")).alias("valid_to_us"))))


def metadata_history(updates: DataFrame, chunk_rows: int = 2_000) -> DataFrame:
    """The history of lifecycle_state (case and surrounding blanks aside), is_latest and supersedes (null equals empty) by record_id, on the time line of ingested_at."""
    attributes = {
        "lifecycle_state": F.lower(F.regexp_replace("lifecycle_state", r"(?U)^\s+|\s+$", "")),
        "is_latest": F.col("is_latest"),
        "supersedes": F.coalesce("supersedes", F.lit("")),
    }
    return versions(updates, "record_id", instant_us(F.col("ingested_at")), attributes, ["received_at", "update_id"], chunk_rows).withColumnRenamed("entity", "record_id")
