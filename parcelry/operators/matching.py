"""Names to codes: exact keys, ordered candidates, places in questions, code and name checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import county_candidates, name_key

#: Characters of the pieces that names are found by, and what stands after a name's end.
GRAM, END = 3, "\x01"


def code_by_name(df: DataFrame, name: str, dim: DataFrame, dim_name: str, dim_code: str, out: str) -> DataFrame:
    """Adds out: the code of the name with the same key, or the name itself. Of names that share a key the least code counts."""
    side = dim.groupBy(name_key(F.col(dim_name)).alias("__key")).agg(F.min(dim_code).alias("__code"))
    joined = df.withColumn("__k", name_key(F.col(name))).join(side, F.col("__k") == F.col("__key"), "left")
    return joined.withColumn(out, F.coalesce("__code", name)).drop("__k", "__key", "__code")


def fill_county(df: DataFrame, row_id: str, state: str, name: str, code: str, dim: DataFrame) -> DataFrame:
    """Fills null codes from dim (state, county_name, county_fips) by the first of the name's candidates that it has.

    Only rows without a code are looked up; a row's candidates are few and meet again by its id.
    """
    known = df.filter(F.col(code).isNotNull())
    open_rows = df.filter(F.col(code).isNull())
    tries = open_rows.select(F.col(row_id).alias("__row"), F.col(state).alias("__state"), F.posexplode(county_candidates(F.col(name))).alias("__place", "__name"))
    names = dim.select(F.col("state").alias("__s"), F.explode(county_candidates(F.col("county_name"))).alias("__n"), F.col("county_fips").alias("__fips"))
    names = names.groupBy("__s", "__n").agg(F.min("__fips").alias("__fips"))
    found = tries.join(names, (F.col("__state") == F.col("__s")) & (F.col("__name") == F.col("__n"))).groupBy("__row").agg(F.min_by("__fips", "__place").alias("__found"))
    filled = open_rows.join(found, F.col(row_id) == F.col("__row"), "left").withColumn(code, F.col("__found")).select(df.columns)
    return known.unionByName(filled)


def _pieces(text: Column, last: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(GRAM))))


def name_postings(names: DataFrame, name: str) -> DataFrame:
    """(gram, name): the distinct names in lower case by each piece of GRAM characters, one for each place in a name at
    most; the last pieces are filled with END. Made once, it serves any number of find_names."""
    distinct = names.select(F.lower(name).alias("name")).filter("name is not null").distinct()
    return distinct.select(F.explode(_pieces(F.concat("name", F.lit(END * (GRAM - 1))), F.length("name"))).alias("gram"), "name")


def find_names(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query, name): names that contain a query, for distinct lower-case queries. A query is looked up by the rarest of its
    pieces alone and then compared; one with a piece that no name has finds nothing. A query shorter than a piece is
    looked up among the distinct pieces, by what they begin with; the empty one is contained in all names."""
    grams = postings.groupBy("gram").agg(F.count("*").alias("n"))
    pieces = queries.filter(F.length("query") >= GRAM).select("query", F.explode(_pieces(F.col("query"), F.length("query") - GRAM + 1)).alias("gram"))
    rarest = pieces.join(grams, "gram", "left").groupBy("query").agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0).cast("long")), F.col("gram"))).alias("r"))
    chosen = rarest.filter("r.n is not null").select("query", F.col("r.gram").alias("gram"))
    found = chosen.join(postings, "gram").filter(F.contains("name", "query")).select("query", "name")
    starts = grams.select("gram", F.explode(F.transform(F.sequence(F.lit(0), F.lit(GRAM - 1)), lambda n: F.substr(F.col("gram"), F.lit(1), n))).alias("query"))
    short = queries.filter(F.length("query") < GRAM).join(starts, "query").join(postings, "gram").select("query", "name").distinct()
    return found.unionByName(short)


def count_places(requests: DataFrame, places: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(request_id, query, n, first_code, last_name): of the requests without a state that have a place, the number of the
    places that resolve_places finds, the least code and the last name. Names are counted for each distinct text before the
    requests meet them, so that requests times places never become rows."""
    asked = requests.filter("state is null").select("request_id", "query", F.lower("query").alias("__query"))
    per_name = places.filter("place_name is not null").groupBy(F.lower("place_name").alias("__name")).agg(F.count("*").alias("n"), F.min("place_code").alias("first_code"), F.max("place_name").alias("last_name"))
    names = find_names(asked.select(F.col("__query").alias("query")).filter("query is not null").distinct(), name_postings(places, "place_name") if postings is None else postings)
    by_text = names.join(per_name, F.col("name") == F.col("__name")).groupBy(F.col("query").alias("__q")).agg(F.sum("n").alias("n"), F.min("first_code").alias("first_code"), F.max("last_name").alias("last_name"))
    each = asked.join(by_text, F.col("__query") == F.col("__q"))
    return each.groupBy("request_id", "query").agg(F.sum("n").alias("n"), F.min("first_code").alias("first_code"), F.max("last_name").alias("last_name"))


def resolve_places(requests: DataFrame, places: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """All places (state, state_name, place_code, place_name) whose name contains a request's (request_id, query, state)
    in any case, with match_count. The state, an abbreviation or a full name, is an equality, so requests with a
    state never meet places of other states. Those without one find names by name_postings of the places (made here, if
    they are not given).
    """
    p = places.select("state", "state_name", "place_code", "place_name")
    hit = F.contains(F.lower("place_name"), F.lower("query"))
    by_state = requests.filter("state is not null").withColumnRenamed("state", "asked")
    keyed = p.select("*", F.explode(F.array_distinct(F.array(F.lower("state"), F.lower("state_name")))).alias("__key"))
    with_state = by_state.join(keyed, F.lower("asked") == F.col("__key")).filter(hit).select("request_id", "query", "state", "place_code", "place_name")
    asked = requests.filter("state is null").drop("state").withColumn("__query", F.lower("query"))
    names = find_names(asked.select(F.col("__query").alias("query")).filter("query is not null").distinct(), name_postings(p, "place_name") if postings is None else postings)
    names = names.select(F.col("query").alias("__q"), F.col("name").alias("__name"))
    without = asked.join(names, F.col("__query") == F.col("__q")).join(p, F.lower("place_name") == F.col("__name")).select("request_id", "query", "state", "place_code", "place_name")
    found = with_state.unionByName(without)
    counts = found.groupBy("request_id").agg(F.count("*").alias("match_count")).withColumnRenamed("request_id", "__id")
    return found.join(counts, F.col("request_id") == F.col("__id")).drop("__id")


def check_codes(claims: DataFrame, dim: DataFrame, dim_code: str, dim_name: str) -> DataFrame:
    """status of each (claim_id, code, text): ok if the text has the code or a word of its name, else wrong_name;
    unknown_code if the dimension lacks it."""
    side = dim.select(F.col(dim_code).alias("__code"), F.col(dim_name).alias("__name"))
    words = F.filter(F.split(F.lower("__name"), "[^a-z]+"), lambda t: (t != "") & (t != "county"))
    said = F.exists(words, lambda t: F.contains(F.lower(F.col("text")), t))
    status = F.when(F.contains(F.col("text"), F.col("code")), "ok").when(F.col("__code").isNull(), "unknown_code").when(said, "ok").otherwise("wrong_name")
    return claims.join(side, F.col("code") == F.col("__code"), "left").select("claim_id", "code", status.alias("status"))
