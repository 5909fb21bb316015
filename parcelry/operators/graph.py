"""Node and edge tables of the geographic hierarchy, and their audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keep import keep_first

EDGE = ("src_label", "src_id", "rel_type", "dst_label", "dst_id")


def _first(columns: Column, order: Sequence[str]) -> Column:
    """Aggregate: the columns of the first row in the order, nulls last; partial before the shuffle, as no window is."""
    return F.min_by(columns, F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))]))


def nodes(df: DataFrame, label: str, id_col: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(label, id, columns): one node per non-null id, the first in the order."""
    one = df.dropna(subset=[id_col]).groupBy(F.col(id_col).cast("string").alias("__id")).agg(_first(F.struct(*columns), order).alias("__first"))
    return one.select(F.lit(label).alias("label"), F.col("__id").alias("id"), *[F.col(f"__first.{c}").alias(c) for c in columns])


@dataclass(frozen=True)
class Pattern:
    """Edges from src to dst nodes whose `match` columns equal the `foreign` columns of the source's table, or of table
    `via`, which holds the source's id as `src_id`."""

    src: str
    rel: str
    dst: str
    foreign: tuple[str, ...]
    match: tuple[str, ...] = ("id",)
    via: str | None = None
    src_id: str = "id"


# The patterns of the graph, with the names that its tables give their keys.
PATTERNS = (
    Pattern("County", "IN_STATE", "State", ("state_fips",)),
    Pattern("MetroArea", "IN_STATE", "State", ("state_fips",)),
    Pattern("CensusTract", "IN_COUNTY", "County", ("county_fips",)),
    Pattern("CensusTract", "IN_METRO", "MetroArea", ("cbsa_code",)),
    Pattern("County", "IN_METRO", "MetroArea", ("cbsa_code",)),
    Pattern("QCTDesignation", "APPLIES_TO", "CensusTract", ("tract_fips",)),
    Pattern("SDDADesignation", "APPLIES_TO", "MetroArea", ("fmr_area_code",), ("fmr_area_code",)),
    Pattern("NMDDADesignation", "APPLIES_TO", "County", ("county_fips",)),
    Pattern("StateAMILimit", "APPLIES_TO", "State", ("state_fips",)),
    Pattern("LenderBehaviorRisk", "APPLIES_TO", "MetroArea", ("cbsa_code",)),
    Pattern("LenderBehaviorRisk", "APPLIES_TO", "County", ("county_fips",)),
    Pattern("County", "HAS_MSA_AMI", "Section8AMILimit", ("hud_area_code", "year"), ("hud_area_code", "year"), "crosswalk", "county_fips"),
    Pattern("County", "HAS_STATE_AMI", "StateAMILimit", ("state_fips",), ("state_fips",), "non_metro", "county_fips"),
)

#: Columns that are no properties of a label's nodes: foreign keys that edges hold, and what loads are marked with.
EXCLUDED: Mapping[str, Sequence[str]] = {"QCTDesignation": ("tract_fips",), "SDDADesignation": ("fmr_area_code",), "NMDDADesignation": ("county_fips",)}
MARKS = ("content_hash", "ingested_at", "run_id")


def _key(columns: Sequence[str]) -> Column:
    """The columns as one key of strings; null if one of them is null or empty."""
    texts = [F.col(c).cast("string") for c in columns]
    there = F.lit(True)
    for t in texts:
        there = there & t.isNotNull() & (t != "")
    return F.when(there, F.array(*texts))


#: Parts that the sources of a key other than the target's id are dealt to: such a key may join many sources to many targets.
SALTS = 16


def _with_all_keys(rows: DataFrame, name: str, may_be_several: bool) -> DataFrame:
    """Adds `name`, all keys of the row's node, where it has several. A target found by its id has this one only."""
    none = F.lit(None).cast("array<array<string>>")
    if not may_be_several:
        return rows.withColumn(name, none)
    keyed = rows.groupBy(*[c for c in rows.columns if c != "key"]).agg(F.collect_set("key").alias("keys"))
    return keyed.select("*", F.explode("keys").alias("key"), F.when(F.size("keys") > 1, F.col("keys")).alias(name)).select(*rows.columns, name)


def all_edges(tables: Mapping[str, DataFrame], patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """The edges of all patterns, by one join: each table is read once for what leaves it, as rows of tagged foreign keys,
    and once for what reaches it. tables: by label, with the column id, and those that patterns go via. Edges that repeat
    are one; those to nodes that aren't there, or via a source that isn't, are none.

    Rows are made distinct before the join and not after it, as the join may give many more than it is given; a node with
    several keys carries them all, and so each of its edges is kept once."""
    leaving = reaching = None
    for name in dict.fromkeys(p.via or p.src for p in patterns):
        own, df = [p for p in patterns if (p.via or p.src) == name], tables[name]
        for p in own:
            if p.via:  # unless a county is a node, a row of the crosswalk leads nowhere
                df = df.join(tables[p.src].select(F.col("id").alias("__id")).distinct(), F.col(p.src_id).cast("string") == F.col("__id").cast("string"), "left_semi")
        each = F.array(*[F.struct(F.lit(p.src).alias("src_label"), F.col(p.src_id).cast("string").alias("src_id"), F.lit(p.rel).alias("rel_type"), F.lit(p.dst).alias("dst_label"), F.lit(" ".join(p.match)).alias("by"), _key(p.foreign).alias("key")) for p in own])
        rows = df.select(F.explode(F.filter(each, lambda e: e["key"].isNotNull() & e["src_id"].isNotNull())).alias("e")).select("e.*")
        rows = _with_all_keys(rows, "src_keys", any(p.match != ("id",) for p in own)).withColumn("salt", F.when(F.col("by") == "id", 0).otherwise(F.pmod(F.xxhash64("src_id"), F.lit(SALTS)).cast("int")))
        leaving = rows if leaving is None else leaving.unionByName(rows)
    for label in dict.fromkeys(p.dst for p in patterns):
        matches = dict.fromkeys(p.match for p in patterns if p.dst == label)
        each = F.array(*[F.struct(F.lit(label).alias("dst_label"), F.lit(" ".join(m)).alias("by"), _key(m).alias("key"), F.col("id").cast("string").alias("dst_id")) for m in matches])
        rows = tables[label].select(F.explode(F.filter(each, lambda e: e["key"].isNotNull() & e["dst_id"].isNotNull())).alias("e")).select("e.*")
        rows = _with_all_keys(rows, "dst_keys", any(m != ("id",) for m in matches))
        if any(m != ("id",) for m in matches):
            rows = rows.withColumn("salt", F.explode(F.when(F.col("by") == "id", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        else:
            rows = rows.withColumn("salt", F.lit(0))
        reaching = rows if reaching is None else reaching.unionByName(rows)
    on = ["dst_label", "by", "key", "salt"]
    n = int(leaving.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = leaving.repartition(n, *on).distinct().join(reaching.repartition(n, *on).distinct(), on)
    # a source and a target that share several keys meet at the least of them
    shared = F.col("src_keys").isNull() | F.col("dst_keys").isNull() | (F.col("key") == F.array_min(F.array_intersect("src_keys", "dst_keys")))
    found = joined.filter(shared).select(*EDGE)
    # patterns of one name that match by different columns may give an edge each
    return found if len({(p.src, p.rel, p.dst, p.match) for p in patterns}) == len({(p.src, p.rel, p.dst) for p in patterns}) else found.distinct()


def all_nodes(tables: Mapping[str, DataFrame], labels: Sequence[str], order: Mapping[str, Sequence[str]] | None = None, excluded: Mapping[str, Sequence[str]] = EXCLUDED) -> DataFrame:
    """(label, id, properties): one node per label and non-null id, the first in the label's order (by default of its
    properties); properties are the JSON of its columns that are neither excluded nor MARKS, without nulls."""
    out = None
    for label in labels:
        df = tables[label]
        own = [c for c in df.columns if c not in (*excluded.get(label, ()), *MARKS)]
        marked = df.dropna(subset=["id"]).select(F.col("id").cast("string").alias("__id"), F.to_json(F.struct(*own)).alias("properties"), *[F.col(c).alias(f"__{c}") for c in (order or {}).get(label, ())])
        one = marked.groupBy("__id").agg(_first(F.col("properties"), [f"__{c}" for c in (order or {}).get(label, ())] or ["properties"]).alias("properties"))
        one = one.select(F.lit(label).alias("label"), F.col("__id").alias("id"), "properties")
        out = one if out is None else out.unionByName(one)
    return out


def pattern_audit(edge_table: DataFrame, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """(rel_type, src_label, dst_label, n, status) of every pattern, MISSING where it has no edge."""
    known = edge_table.sparkSession.createDataFrame([(p.rel, p.src, p.dst) for p in patterns], "rel_type string, src_label string, dst_label string")
    found = known.join(edge_counts(edge_table), ["rel_type", "src_label", "dst_label"], "left")
    return found.select("rel_type", "src_label", "dst_label", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("n").isNull(), "MISSING").otherwise("OK").alias("status"))


def edges(fact: DataFrame, src_label: str, src_id: str, rel: str, dst_label: str, foreign: Column, anchors: DataFrame, anchor_id: str, also: Mapping[str, str] | None = None) -> DataFrame:
    """Edges of facts to anchors that exist; no edge for a null or empty key; repeated ones are one. `also` holds
    further equalities, fact column to anchor column (the year, say)."""
    f = fact.select(F.col(src_id).cast("string").alias("s"), foreign.cast("string").alias("__k"), *[F.col(c).alias(f"__f_{c}") for c in (also or {})])
    a = anchors.select(F.col(anchor_id).cast("string").alias("d"), *[F.col(c).alias(f"__a_{c}") for c in (also or {}).values()]).distinct()
    on = F.col("__k") == F.col("d")
    for x, y in (also or {}).items():
        on = on & (F.col(f"__f_{x}") == F.col(f"__a_{y}"))
    joined = f.filter("__k is not null and __k <> ''").join(a, on)
    return joined.select(F.lit(src_label).alias("src_label"), F.col("s").alias("src_id"), F.lit(rel).alias("rel_type"), F.lit(dst_label).alias("dst_label"), F.col("d").alias("dst_id")).distinct()


def through_crosswalk(counties: DataFrame, county: str, crosswalk: DataFrame, limits: DataFrame, limit_id: str, code: str = "hud_area_code", year: str = "year") -> DataFrame:
    """County to limit edges (many to many): counties meet limits of their area code in the same year."""
    kinds = [crosswalk.schema[c].dataType for c in (code, year)]
    # keys as in all_edges: distinct rows before the join, none made distinct after it
    key = lambda *columns: F.when(F.col(columns[0]).isNotNull() & F.col(columns[1]).isNotNull(), F.array(*[F.col(c).cast(k).cast("string") for c, k in zip(columns, kinds, strict=True)])).alias("key")
    leaving = counties.select(F.col(county).alias("__county")).distinct().join(crosswalk.select("county_fips", key(code, year)), F.col("__county") == F.col("county_fips")).filter("key is not null")
    leaving = _with_all_keys(leaving.select(F.col("__county").cast("string").alias("src_id"), "key"), "src_keys", True).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    reaching = _with_all_keys(limits.select(F.col(limit_id).cast("string").alias("dst_id"), key(code, year)).filter("key is not null"), "dst_keys", True).withColumn("salt", F.pmod(F.xxhash64("dst_id"), F.lit(SALTS)).cast("int"))
    n = int(limits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = reaching.repartition(n, "key", "salt").join(leaving, ["key", "salt"])
    one = F.col("src_keys").isNull() | F.col("dst_keys").isNull() | (F.col("key") == F.array_min(F.array_intersect("src_keys", "dst_keys")))
    return joined.filter(one).select(F.lit("County").alias("src_label"), "src_id", F.lit("HAS_MSA_AMI").alias("rel_type"), F.lit("Section8AMILimit").alias("dst_label"), "dst_id")


def first_metro(areas: DataFrame, code: str, metro: str, order: Sequence[str]) -> DataFrame:
    """(code, metro): the first non-null metro of each area code."""
    return keep_first(areas.dropna(subset=[code, metro]), [code], order).select(code, metro)


def enrich(df: DataFrame, dim: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """df with columns replaced by the dimension's values where it has them."""
    side = dim.select(F.col(on).alias("__on"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(side, F.col(on) == F.col("__on"), "left")
    kept = [c for c in df.columns if c not in columns]
    return joined.select(*kept, *[(F.coalesce(f"__{c}", c) if c in df.columns else F.col(f"__{c}")).alias(c) for c in columns])


def without_edges(edge_table: DataFrame, src_label: str, rel: str, dst_label: str) -> DataFrame:
    """The table without the (stale) edges of one pattern."""
    return edge_table.filter(~((F.col("src_label") == src_label) & (F.col("rel_type") == rel) & (F.col("dst_label") == dst_label)))


def orphans(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Nodes that no edge leaves or reaches."""
    ends = edge_table.select(F.explode(F.array(F.struct(F.col("src_label").alias("l"), F.col("src_id").alias("i")), F.struct(F.col("dst_label").alias("l"), F.col("dst_id").alias("i")))).alias("e")).select("e.*").distinct()
    return node_table.join(ends, (F.col("label") == F.col("l")) & (F.col("id") == F.col("i")), "left_anti")


def audit(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """label, n_nodes, n_out, n_in, n_connected, n_orphans, orphan_pct per label, from one aggregation by (label, id) of nodes
    and edge ends together."""
    end = lambda side, out: F.struct(F.col(f"{side}_label").alias("label"), F.col(f"{side}_id").alias("id"), F.lit(0).alias("node"), F.lit(out).alias("out"), F.lit(1 - out).alias("in"))
    ends = edge_table.select(F.explode(F.array(end("src", 1), end("dst", 0))).alias("e")).select("e.*")
    rows = node_table.select("label", "id", F.lit(1).alias("node"), F.lit(0).alias("out"), F.lit(0).alias("in")).unionByName(ends)
    by_id = rows.groupBy("label", "id").agg(*[F.sum(c).alias(c) for c in ("node", "out", "in")])
    j = by_id.groupBy("label").agg(F.sum("node").alias("n_nodes"), F.sum("out").alias("n_out"), F.sum("in").alias("n_in"), F.sum(F.when(F.col("out") + F.col("in") == 0, F.col("node")).otherwise(0)).alias("n_orphans")).filter("n_nodes > 0")
    return j.select("label", "n_nodes", "n_out", "n_in", (F.col("n_nodes") - F.col("n_orphans")).alias("n_connected"), "n_orphans", F.round(F.col("n_orphans") * 100.0 / F.col("n_nodes"), 4).cast("double").alias("orphan_pct"))


def edge_counts(edge_table: DataFrame) -> DataFrame:
    return edge_table.groupBy("src_label", "rel_type", "dst_label").agg(F.count("*").alias("n"))
