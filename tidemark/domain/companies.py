"""Companies: places, identifiers, calendars, the registry of stable ids."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.domain.intraday import minute_of_day, new_york
from tidemark.functions.semantics import col
from tidemark.functions.text import plain, place_variants
from tidemark.operators.joins import forward_window_first
from tidemark.operators.windows import latest

# District words left out of city names.
DISTRICT_WORDS = ("cedex", "ku", "shi", "city", "district", "gun", "si", "dong", "town", "municipality", "co", "selatan", "pusat", "utara", "barat", "timur", "england", "surrey")
WORLD_POPULATION = 100_000


# calendars ----------------------------------------------------------------------------------------------------------
def time_of_day(utc) -> Column:
    """bmo before 09:30 in New York, amc from 16:00, during between."""
    m = minute_of_day(new_york(utc))
    return F.when(m < 570, "bmo").when(m >= 960, "amc").when(m.isNotNull(), "during")


def next_quarter(year, quarter) -> tuple[Column, Column]:
    last = col(quarter) == 4
    return F.when(last, col(year) + 1).otherwise(col(year)), F.when(last, 1).otherwise(col(quarter) + 1)


def earnings_dates(quarters: DataFrame, filings: DataFrame, days: int = 90) -> DataFrame:
    """quarters (company, fiscal_year, fiscal_quarter, period_end) with the date and time of day of the first results filing
    within `days` after their end. filings: company, items, accepted (UTC)."""
    f = filings.where(F.col("items").contains("2.02")).select("company", F.to_date(new_york("accepted")).alias("earnings_date"), time_of_day("accepted").alias("earnings_time"))
    return forward_window_first(quarters, f, "company", "period_end", "earnings_date", days)


def upcoming_quarter(quarters: DataFrame) -> DataFrame:
    """The quarter after each company's latest."""
    last = latest(quarters, "company", [F.desc("fiscal_year"), F.desc("fiscal_quarter")])
    y, q = next_quarter("fiscal_year", "fiscal_quarter")
    return last.select("company", y.alias("fiscal_year"), q.alias("fiscal_quarter"))


# places -------------------------------------------------------------------------------------------------------------
def place_index(places: DataFrame) -> DataFrame:
    """(country, name, population, admin1, lat, lon) for every name of a place."""
    names = F.array_distinct(F.concat(F.array("name", "asciiname"), F.split(F.coalesce("alternatenames", F.lit("")), ",")))
    p = places.select("country", F.explode(names).alias("raw"), "population", "admin1", "lat", "lon")
    return p.withColumn("name", plain("raw")).where("name <> ''").drop("raw").distinct()


def geocode(offices: DataFrame, places: DataFrame) -> DataFrame:
    """offices (id, city, state, iso) with lat, lon, method: exact name, a place that begins with it, a single word of it, or a
    large city anywhere. Earlier variants and the same state come first, then the larger place."""
    idx = place_index(places)
    tries = offices.select("id", "state", "iso", F.posexplode(place_variants("city", DISTRICT_WORDS)).alias("i", "name"))
    same = lambda d: F.coalesce(F.upper("state") == F.upper("admin1"), F.lit(False))
    words = F.split("name", " ")
    # a place's leading words stand for it in the second tier
    begin = idx.withColumn("full", F.col("name")).withColumn("name", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda k: F.array_join(F.slice(words, 1, k), " ")))).where("name <> full").drop("full")
    single = tries.select("id", "state", "iso", "i", F.explode(words).alias("name")).where((F.length("name") >= 4) & ~F.col("name").isin(*DISTRICT_WORDS))
    hits = None
    for tier, (t, d) in enumerate(((tries, idx), (tries, begin), (single, idx))):
        h = t.join(d.withColumnRenamed("country", "iso"), ["iso", "name"]).select("id", F.lit(tier).alias("tier"), "i", same(None).alias("same"), "population", "lat", "lon", F.lit("city").alias("method"))
        hits = h if hits is None else hits.unionByName(h)
    world = tries.join(idx.where(F.col("population") > WORLD_POPULATION).drop("country"), "name").select("id", F.lit(3).alias("tier"), "i", F.lit(False).alias("same"), "population", "lat", "lon", F.lit("city_world").alias("method"))
    best = latest(hits.unionByName(world), "id", ["tier", "i", F.desc("same"), F.desc("population"), "lat", "lon"])
    return offices.join(best.select("id", "lat", "lon", "method"), "id", "left")


def spread(points: DataFrame, by=("lat", "lon"), step: float = 0.05) -> DataFrame:
    """Points of one place laid out on a golden-angle spiral."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy("id")) - 1
    angle, radius = k * 2.399963229728653, step * F.sqrt(k.cast("double"))
    return points.withColumn("lat_shown", F.col("lat") + radius * F.cos(angle)).withColumn("lon_shown", F.col("lon") + radius * F.sin(angle))


# fields -------------------------------------------------------------------------------------------------------------
def prefer(*sources: Column) -> Column:
    return F.coalesce(*sources)


def differing_groups(df: DataFrame, name: str, attributes: list[str]) -> DataFrame:
    """Names whose rows differ in an attribute."""
    g = df.groupBy(name).agg(F.count("*").alias("n"), *[F.countDistinct(a).alias(a) for a in attributes])
    cond = F.lit(False)
    for a in attributes:
        cond = cond | (F.col(a) > 1)
    return g.where(cond)


# ids ----------------------------------------------------------------------------------------------------------------
def ticker_map(registry: DataFrame) -> DataFrame:
    return registry.select(F.explode(F.split("tickers", ";")).alias("ticker"), "corporate_id").where("ticker <> ''")


def company_name(name) -> Column:
    """A security's name without its share class or series."""
    return F.trim(F.regexp_replace(col(name), r"\s+(Class|Series)\s+[A-Z]\b.*$", ""))


#: The numbers that ids are drawn from.
ID_SPACE = (10_000, 100_000)


def assign_ids(equities: DataFrame, registry: DataFrame, old: DataFrame, seed: int = 0, today: str = "") -> tuple[DataFrame, DataFrame]:
    """(registry, changes) after the equities of today: stable ids of companies as a plan of joins.

    equities: ticker, name, place (its order in the list), cik, rank. registry: corporate_id, company_name, cik, tickers (with
    semicolons), assigned_at, merged_into, status. old: ticker, corporate_id. changes: kind (new, kept, merged, split), n.

    Tickers of one CIK, or of one name without a CIK, are a company. A ticker claims the id that it is registered or was once
    known under. An id belongs to the company of its first listed ticker that is still there, else to the best claim; claims
    by others are splits. A company keeps the id of its leading ticker, and its other ids are merged into that one. Companies
    without an id get one that was never used. Ids are fewer than the id space, so numbering is over a bounded table.
    """
    once = F.struct((~F.col("name").contains("Class A")).alias("other_class"), F.coalesce("rank", F.lit(2**31 - 1)).alias("rank"), "place")
    firm = F.coalesce(F.concat(F.lit("cik "), F.col("cik").cast("string")), F.concat(F.lit("name "), F.trim("name")))
    members = equities.select("ticker", "name", "cik", firm.alias("firm"), once.alias("turn"))

    listed = registry.select("corporate_id", "status", F.posexplode(F.split(F.coalesce("tickers", F.lit("")), ";")).alias("at", "ticker")).where("ticker <> ''")
    registered = listed.where("status <> 'reassigned'").groupBy("ticker").agg(F.max("corporate_id").alias("now"))
    known = old.groupBy("ticker").agg(F.max("corporate_id").alias("then"))
    claims = members.join(registered, "ticker", "left").join(known, "ticker", "left").withColumn("id", F.coalesce("now", "then")).where("id IS NOT NULL")
    by_listing = listed.join(members, "ticker").groupBy(F.col("corporate_id").alias("id")).agg(F.min_by("firm", "at").alias("listed_firm"))
    by_claim = claims.groupBy("id").agg(F.min_by("firm", "turn").alias("claim_firm"))
    judged = claims.join(by_listing, "id", "left").join(by_claim, "id").withColumn("mine", F.col("firm") == F.coalesce("listed_firm", "claim_firm"))

    ids = judged.where("mine").groupBy("firm", "id").agg(F.min("turn").alias("turn"), F.min_by("name", "turn").alias("claim_name"))
    mains = ids.groupBy("firm").agg(F.min_by("id", "turn").alias("main"))
    firms = members.groupBy("firm").agg(F.first("cik").alias("cik"), F.min("turn").alias("turn"), F.sort_array(F.collect_list(F.struct("turn", "ticker", "name"))).alias("members"))
    firms = firms.join(mains, "firm", "left")

    used = registry.select("corporate_id").union(old.select("corporate_id"))
    free = equities.sparkSession.range(*ID_SPACE).withColumnRenamed("id", "corporate_id").join(used, "corporate_id", "left_anti")
    free = free.withColumn("nth", F.row_number().over(Window.orderBy(F.xxhash64("corporate_id", F.lit(seed)), "corporate_id")))
    fresh = firms.where("main IS NULL").withColumn("nth", F.row_number().over(Window.orderBy("turn")))
    numbered = fresh.join(free, "nth", "left").select("firm", F.coalesce("corporate_id", F.raise_error(F.lit("no free ids are left"))).alias("drawn"))
    firms = firms.join(numbered, "firm", "left").withColumn("corporate_id", F.coalesce("main", "drawn").cast("long"))

    before = registry.select("corporate_id", F.col("cik").alias("cik_before"), "assigned_at", F.split(F.coalesce("tickers", F.lit("")), ";").alias("tickers_before"))
    present = members.agg(F.collect_set("ticker").alias("present"))  # one row; the list of equities is smaller than the id space
    current = firms.join(before, "corporate_id", "left").crossJoin(F.broadcast(present))
    gone = F.filter(F.array_except(F.coalesce("tickers_before", F.array().cast("array<string>")), "present"), lambda x: x != "")
    active = current.select("corporate_id", company_name(F.col("members")[0]["name"]).alias("company_name"), F.coalesce("cik", "cik_before").alias("cik"), F.array_join(F.array_distinct(F.concat(F.transform("members", lambda m: m["ticker"]), gone)), ";").alias("tickers"),
                            F.coalesce("assigned_at", F.lit(today)).alias("assigned_at"), F.lit(None).cast("long").alias("merged_into"), F.lit("active").alias("status"))

    losers = ids.join(mains, "firm").where("id <> main").select(F.col("id").alias("corporate_id"), "main", "claim_name")
    held = registry.select("corporate_id", F.col("company_name").alias("name_before"), F.col("cik").alias("cik_before"), F.col("assigned_at").alias("date_before"))
    merged = losers.join(held, "corporate_id", "left").select("corporate_id", F.coalesce("name_before", "claim_name").alias("company_name"), F.col("cik_before").alias("cik"), F.lit("").alias("tickers"),
                                                              F.coalesce("date_before", F.lit(today)).alias("assigned_at"), F.col("main").cast("long").alias("merged_into"), F.lit("merged").alias("status"))
    moved = active.select("corporate_id").union(merged.select("corporate_id"))
    rest = registry.join(moved, "corporate_id", "left_anti").crossJoin(F.broadcast(present))
    lost = ~F.col("status").isin("merged", "reassigned") & ~F.arrays_overlap(F.split(F.coalesce("tickers", F.lit("")), ";"), F.col("present"))
    rest = rest.withColumn("status", F.when(lost, "removed").otherwise(F.col("status"))).select(*active.columns)

    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    changes = count(firms.where("main IS NULL"), "new").union(count(mains, "kept")).union(count(losers, "merged")).union(count(judged.where("NOT mine"), "split"))
    return active.unionByName(merged).unionByName(rest), changes
