"""The driver's tables seen as searches, options, observations and landed responses."""
from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from fareloom import schema
from fareloom.operators import features as feat
from fareloom.session import fresh_path
from fareloom.sources.writers import write_bucketed, write_laid_out
from fareloom.streaming.ingest import observations_from

# Buckets of the tables stored by search id.
BUCKETS = 16
_written: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_path(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Path of a derived input, written once per session by `write(path)`."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = fresh_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table read back from Parquet, the way analytics read the processed table."""
    path = written_path(spark, sf_dir, name, lambda p: build().write.parquet(p))
    return spark.read.parquet(path)


def derived(spark: SparkSession, sf_dir: str, name: str, build, columns: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """A derived table: as stored, if this session has stored it whole.

    Otherwise a query that reads it `once` gets it computed, where the plan reads and shuffles only what the query uses; and
    of a table that a query reads more often, only the `columns` that it uses are stored, if it names them.
    """
    if (spark.sparkContext.applicationId, sf_dir, name) in _written:
        return stored(spark, sf_dir, name, build)
    if once:
        return build()
    if columns:
        return stored(spark, sf_dir, "-".join([name, *columns]), lambda: build().select(*columns))
    return stored(spark, sf_dir, name, build)


# Suppliers, a key and a nation each, are broadcast up to this many rows, some 50 bytes each.
SUPPLIERS = 1_000_000


def _in_region(rows: DataFrame, sf_dir: str, nation: str, alias: str) -> DataFrame:
    """Rows with the name of their nation's region. The look-up of nations comes after the join that brings the nation key,
    so that Spark knows the size of that join's table from its files."""
    n, r = (table(rows.sparkSession, sf_dir, t) for t in ("nation", "region"))
    names = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("_nk"), F.col("r_name").alias(alias))
    return rows.join(F.broadcast(names), F.col(nation) == F.col("_nk")).drop("_nk", nation)


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per order, some of them within one region."""
    o, r, c = (table(spark, sf_dir, t) for t in ("orders", "region", "customer"))
    rows = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = _in_region(rows, sf_dir, "c_nationkey", "origin")
    rows = rows.join(r, F.pmod("o_orderkey", F.lit(5)) == F.col("r_regionkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"), "origin", F.col("r_name").alias("destination"),
        F.to_date("o_orderdate").alias("outbound_date"), F.lit(None).cast("date").alias("return_date"),
        F.lit("INR").alias("currency"), F.col("o_orderdate").cast("timestamp").alias("searched_at"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("request_id"),
    )


def _options(spark, sf_dir):
    l, o, p, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer", "supplier"))
    s = s.select("s_suppkey", "s_nationkey")
    if s.count() <= SUPPLIERS:
        s = F.broadcast(s)
    # Orders meet their customers on their own, so that line items, the widest and most rows, move once for both. They meet
    # line items last and as a hash table: line items are not sorted, which spills where a task has many, and stay dealt by order.
    o = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = _in_region(o, sf_dir, "c_nationkey", "destination").select("o_orderkey", "destination")
    rows = _in_region(l.join(s, F.col("l_suppkey") == F.col("s_suppkey")), sf_dir, "s_nationkey", "origin")
    rows = rows.join(p.select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    lead = (F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13, F.lit(97)) - 2).cast("int")
    ship = F.to_date("l_shipdate")
    hour = F.pmod("l_orderkey", F.lit(24)).cast("int")
    collected = F.timestamp_add("HOUR", hour, F.date_sub(ship, lead).cast("timestamp"))
    back = F.when(F.col("l_linenumber") % 2 == 0, F.date_add(ship, F.col("l_linenumber")))
    return rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("search_id"),
        "origin", "destination", ship.alias("outbound_date"), back.alias("return_date"),
        F.col("l_extendedprice").alias("price"), F.lit("INR").alias("currency"),
        (F.col("l_quantity") * 10 + 60).alias("total_duration_minutes"), F.col("p_type").alias("flight_type"),
        F.col("p_brand").alias("airline"), (F.col("l_linenumber") - 2).alias("stops"),
        (F.col("l_discount") * 1000).alias("carbon_emissions_kg"),
        F.concat("l_returnflag", "l_linestatus").alias("booking_token"), collected.alias("collected_at"),
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    )


_KEYS = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


def options(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """One option per line item, with a non-unique id."""
    return derived(spark, sf_dir, "options", lambda: _options(spark, sf_dir), once=once)


def _observations(spark, sf_dir):
    rows = options(spark, sf_dir, once=True).withColumns({
        "route": F.concat_ws("-", "origin", "destination"), "total_fare": F.col("price"),
        "stops": F.greatest(F.col("stops"), F.lit(0)), "duration_minutes": F.col("total_duration_minutes"),
        "record_id": F.col("id").cast("string"),
    })
    rows = feat.time_features(feat.booking_features(rows))
    return rows.withColumn("fare_outlier", F.col("price") > 90000).drop("collected_at", "l_linenumber", "l_quantity")


def sparse(spark: SparkSession, sf_dir: str, *columns: str, once: bool = False) -> DataFrame:
    """Observations on their own travel dates."""
    return derived(spark, sf_dir, "sparse", lambda: _observations(spark, sf_dir), columns, once)


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations laid out by month of travel."""
    path = written_path(spark, sf_dir, "laid_out", lambda p: write_laid_out(sparse(spark, sf_dir, once=True), p))
    return spark.read.parquet(path)


def bucketed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Searches and options as tables of the session catalog, stored by search id."""
    names = []
    for kind, key, make in (("searches", "id", searches), ("options", "search_id", options)):
        name = f"{kind}_{zlib.crc32(sf_dir.encode()):08x}"
        if not spark.catalog.tableExists(name):
            write_bucketed(make(spark, sf_dir), name, fresh_path(spark, name), key, BUCKETS)
        names.append(name)
    return spark.table(names[0]), spark.table(names[1])


def dense(spark: SparkSession, sf_dir: str, *columns: str, once: bool = False) -> DataFrame:
    """Observations with travel dates moved to the first of the month, so that date groups are large."""
    return sparse(spark, sf_dir, *columns, once=once).withColumn("outbound_date", F.trunc("outbound_date", "month"))


# Route weights used by the index queries.
WEIGHTS = {"AMERICA-ASIA": 0.30, "ASIA-EUROPE": 0.25, "EUROPE-MIDDLE EAST": 0.20, "AFRICA-ASIA": 0.15,
           "MIDDLE EAST-AFRICA": 0.10}


def _dirty(spark, sf_dir):
    rows = options(spark, sf_dir, once=True)
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    text = F.when(k % 53 == 0, "n/a").when(k % 50 == 0, (-F.col("price")).cast("string"))
    text = text.otherwise(F.col("price").cast("string"))
    quoted = F.concat(F.lit('Air "'), F.col("airline"), F.lit('", Ltd'))
    airline = F.when(k % 37 == 0, None).when(k % 41 == 0, "").when(k % 43 == 0, quoted).when(
        s % 3 == 0, F.concat(F.lit("  "), F.replace("airline", F.lit("#"), F.lit("   ")), F.lit(" ")))
    rows = rows.withColumns({
        "price": text, "airline": airline.otherwise(F.col("airline")),
        "outbound_date": F.when(k % 59 == 0, "bad").otherwise(F.col("outbound_date").cast("string")),
        "total_duration_minutes": F.when(F.col("l_quantity") == 1, -F.col("total_duration_minutes"))
        .otherwise(F.col("total_duration_minutes")),
        "currency": F.when(s % 7 == 0, "").otherwise(F.col("currency")),
        "origin": F.when(s % 5 == 0, F.lower("origin")).otherwise(F.col("origin")),
    })
    copies = F.when(F.col("search_id") % 20 == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies))


def dirty(spark: SparkSession, sf_dir: str, *columns: str, once: bool = False) -> DataFrame:
    """Options with bad, missing, padded and repeated values placed by key."""
    return derived(spark, sf_dir, "dirty", lambda: _dirty(spark, sf_dir), columns, once)


def dirty_records(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """The dirty options shaped as collected observations."""
    rows = dirty(spark, sf_dir, "id", "collected_at", "origin", "destination", "outbound_date", "airline",
                 "total_duration_minutes", "stops", "price", "currency", "l_partkey", "l_suppkey", once=once)
    return rows.select(
        F.col("id").cast("string").alias("record_id"), F.col("collected_at").cast("string").alias("collection_timestamp"),
        F.col("origin").alias("departure_airport"), F.col("destination").alias("arrival_airport"), "outbound_date",
        "airline", F.col("total_duration_minutes").alias("duration_minutes"), "stops", F.col("price").alias("total_fare"),
        "price", "currency", F.date_diff(F.col("collected_at").cast("date"), F.lit("1990-01-01").cast("date"))
        .alias("advance_purchase_days"), "l_partkey", "l_suppkey",
    )


def _landed(spark, sf_dir):
    rows = options(spark, sf_dir, once=True)
    end = lambda code, at: F.struct(code.alias("id"), at.alias("time"))

    def itinerary(x):
        n = F.greatest(x["stops"], F.lit(0)) + 1
        seg = lambda i: F.struct(
            x["airline"].alias("airline"), F.concat(F.lit("f-"), i.cast("string")).alias("flight_number"),
            F.lit("Economy").alias("travel_class"),
            end(F.when(i == 1, x["origin"]).otherwise(F.lit("MID")), F.lit("08:00")).alias("departure_airport"),
            end(F.when(i == n, x["destination"]).otherwise(F.lit("MID")), F.lit("12:00")).alias("arrival_airport"))
        ext = F.when(x["l_partkey"] % 10 == 0, F.array(F.lit("Sold  out"))).otherwise(F.array(F.lit("Carry-on")))
        return F.struct(
            x["price"].alias("price"), x["total_duration"].alias("total_duration"), ext.alias("extensions"),
            F.transform(F.sequence(F.lit(1), n), seg).alias("flights"))

    # What itineraries are made from is what is grouped and sorted; in this order it sorts as the itineraries would.
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "price", F.col("total_duration_minutes").cast("int").alias("total_duration"),
                    "airline", "origin", "destination", "stops")
    grouped = rows.groupBy("search_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    part = lambda keep: F.transform(F.filter("items", keep), itinerary)
    body = F.to_json(F.struct(
        part(lambda x: x["l_linenumber"] <= 2).alias("best_flights"),
        part(lambda x: x["l_linenumber"] > 2).alias("other_flights")))
    o = table(spark, sf_dir, "orders")
    stamp = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd HH:mm:ss")
    # Groups and orders meet as groups were dealt; the bodies are made after that.
    return grouped.join(o.hint("shuffle_hash"), F.col("search_id") == F.col("o_orderkey")).select(
        "search_id", F.lit("XXX").alias("departure_airport"), F.lit("YYY").alias("arrival_airport"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), 5), "yyyy-MM-dd").alias("outbound_date"),
        F.lit(None).cast("string").alias("return_date"), F.lit("inr").alias("currency"),
        stamp.alias("collected_at"), body.alias("body"))


def landed(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """One landed response per order, its line items as itineraries."""
    return derived(spark, sf_dir, "landed", lambda: _landed(spark, sf_dir), once=once).select(*schema.LANDED.names)


def flattened(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Observations flattened from the landed responses."""
    build = lambda: observations_from(landed(spark, sf_dir, once=True), "provider", "engine")
    return derived(spark, sf_dir, "flattened", build, once=once)


def _dirty_searches(spark, sf_dir):
    rows = searches(spark, sf_dir)
    i = F.col("id")
    rows = rows.withColumns({
        "origin": F.when(i % 3 == 0, F.concat(F.lit("  "), F.lower("origin"), F.lit(" "))).otherwise(F.col("origin")),
        "outbound_date": F.when(i % 59 == 0, "bad").otherwise(F.col("outbound_date").cast("string")),
        "searched_at": F.date_format("searched_at", "yyyy-MM-dd HH:mm:ss"),
    })
    older = rows.filter(i % 20 == 0).withColumns({"searched_at": F.lit("1970-01-01 00:00:00"), "currency": F.lit("OLD")})
    return rows.unionByName(older)


def _csv(df):
    """Writes CSV by gzip: every task of the plan writes a file, so there are as many to read."""
    plain = {"compression": "gzip", "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return lambda path: df.write.options(**plain).csv(path)


def searches_csv(spark: SparkSession, sf_dir: str) -> str:
    """Path of the searches as CSV, with padded codes, bad dates and older copies of some ids."""
    return written_path(spark, sf_dir, "searches_csv", lambda p: _csv(_dirty_searches(spark, sf_dir))(p))


def options_csv(spark: SparkSession, sf_dir: str) -> str:
    """Path of the dirty options as CSV."""
    rows = dirty(spark, sf_dir, once=True).select(*schema.OPTION.names)
    rows = rows.withColumn("collected_at", F.date_format("collected_at", "yyyy-MM-dd HH:mm:ss"))
    return written_path(spark, sf_dir, "options_csv", lambda p: _csv(rows)(p))


def _as_documents(df, group, compression="none"):
    """One JSON list per file, each of a bounded range of searches."""
    lists = df.groupBy(group.alias("part")).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    return lambda path: lists.write.option("compression", compression).partitionBy("part").text(path)


def records_json(spark: SparkSession, sf_dir: str) -> str:
    """Path of the dirty records as JSON documents, a tenth of the size by gzip: a file is one task's work either way."""
    rows = dirty_records(spark, sf_dir, once=True)
    group = F.floor(F.col("record_id").cast("long") / 16000)
    return written_path(spark, sf_dir, "records_json", lambda p: _as_documents(rows, group, "gzip")(p))


def landed_json(spark: SparkSession, sf_dir: str) -> str:
    """Path of the landed responses as JSON documents."""
    rows = landed(spark, sf_dir)
    return written_path(spark, sf_dir, "landed_json", lambda p: _as_documents(rows, F.floor(F.col("search_id") / 2000))(p))


def damaged_json(spark: SparkSession, sf_dir: str) -> str:
    """Path of the landed responses as JSON documents of 1,000 searches, every fifth document cut off."""
    rows = landed(spark, sf_dir)
    lists = rows.groupBy(F.floor(F.col("search_id") / 1000).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    cut = F.when(F.col("part") % 5 == 2, F.expr("left(value, cast(length(value) / 2 as int))")).otherwise(F.col("value"))
    return written_path(spark, sf_dir, "damaged_json", lambda p: lists.withColumn("value", cut).write.partitionBy("part").text(p))
