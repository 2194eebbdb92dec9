"""Names, keys, ranking and filters of places over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom import points as P
from geoloom import rules
from geoloom.catalog import sql as S
from geoloom.functions import text as X
from geoloom.functions.core import first_non_empty as coalesce_text
from geoloom.functions.core import prefer_existing as keep_old
from geoloom.functions.geodesy import distance_m
from geoloom.operators import ranking as R
from geoloom.operators import summaries as Y
from geoloom.registry import query
from geoloom.tables import table

CLASSES = ("city", "town", "village", "hamlet", "isolated_dwelling")
CLASS_SQL = "list_extract(['city','town','village','hamlet','isolated_dwelling'], CAST(p_size % 5 AS INTEGER) + 1)"


def place_class(c="p_size"):
    return F.element_at(F.array(*[F.lit(v) for v in CLASSES]), (F.col(c) % 5 + 1).cast("int"))


def part(spark, d):
    return table(spark, d, "part").withColumn("place", place_class())


@query("normalize_name", r"SELECT doc_id, regexp_replace(lower(trim(text)), '[^\p{L}\p{Nd}]', '', 'g') AS name_key FROM documents")
def normalize_name(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_name("text").alias("name_key"))


WORDS = " OR ".join(f"contains(n, '{w}')" for w in rules.NAME_STOP_WORDS)
PICK = "list_extract([" + ",".join(f"'{w}'" for w in rules.NAME_STOP_WORDS) + f"], CAST(p_partkey % {len(rules.NAME_STOP_WORDS)} AS INTEGER) + 1)"


@query(
    "usable_name_filter",
    f"WITH s AS (SELECT p_partkey, lower(trim(CASE WHEN p_partkey % 3 = 0 THEN upper({PICK}) || ' ' || p_name WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END)) AS n FROM part) SELECT p_partkey FROM s WHERE n <> '' AND NOT ({WORDS})",
)
def usable_name_filter(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    words = F.array(*[F.lit(w) for w in rules.NAME_STOP_WORDS])
    k = F.col("p_partkey")
    w = F.element_at(words, (k % len(rules.NAME_STOP_WORDS) + 1).cast("int"))
    n = F.when(k % 3 == 0, F.concat(F.upper(w), F.lit(" "), "p_name")).when(k % 11 == 0, " ").otherwise(F.col("p_name"))
    return p.withColumn("n", n).filter(X.usable_name("n")).select("p_partkey")


@query(
    "place_type_filter",
    f"SELECT p_partkey FROM part WHERE (CASE WHEN p_partkey % 2 = 0 THEN {CLASS_SQL} ELSE 'suburb' END) <> 'suburb' OR (p_partkey % 3 = 0 AND CAST(p_size % 13 AS VARCHAR) IN ('9', '10', '11'))",
)
def place_type_filter(spark, d):
    k = F.col("p_partkey")
    p = part(spark, d).withColumns(
        {"place": F.when(k % 2 == 0, F.upper("place")).otherwise("suburb"),
         "boundary": F.when(k % 3 == 0, "Administrative").otherwise(""), "level": (F.col("p_size") % 13).cast("string")}
    )
    return p.filter(X.place_type_filter("place", "boundary", "level")).select("p_partkey")


SOURCES = "['local', ' ', 'multi-provider', 'Overpass api', 'my OpenStreetMap', 'Azure Maps/Polygon', 'Geoapify/Boundaries', 'Google/Geocoding (POC)', 'Bing Maps/Locations', 'GraphHopper/Geocoding', 'Map geocoder/Test', 'unknown']"
SOURCE_LIST = [v.strip().strip("'") if v.strip() != "' '" else " " for v in SOURCES[1:-1].split(",")]


def _source():
    return F.element_at(F.array(*[F.lit(v) for v in SOURCE_LIST]), (F.col("l_partkey") % len(SOURCE_LIST) + 1).cast("int"))


SRC_SQL = f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_extract({SOURCES}, CAST(l_partkey % 12 AS INTEGER) + 1) AS src FROM lineitem),
c AS (SELECT *, CASE WHEN trim(src) = '' OR src = 'local' THEN 'Legacy cache' WHEN src = 'multi-provider' THEN '' WHEN lower(src) LIKE '%overpass%' OR lower(src) LIKE '%openstreetmap%' THEN 'OpenStreetMap/Overpass' ELSE src END AS provider FROM s)"""
LI = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("classify_source", SRC_SQL + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, provider FROM c")
def classify_source(spark, d):
    return table(spark, d, "lineitem").select(*LI, rules.classify_source(_source()).alias("provider"))


@query(
    "source_priority",
    SRC_SQL + """, r(p, n) AS (VALUES ('Azure Maps/Polygon', 120), ('OpenStreetMap/Overpass', 115), ('Geoapify/Boundaries', 105), ('Google/Geocoding (POC)', 85), ('Bing Maps/Locations', 80), ('GraphHopper/Geocoding', 75), ('Map geocoder/Test', 60))
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(n, 10) AS priority FROM c LEFT JOIN r ON p = provider""",
)
def source_priority(spark, d):
    return table(spark, d, "lineitem").select(*LI, rules.source_priority(_source()).alias("priority"))


def _tags(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    tags = F.create_map(
        F.lit("name"), F.concat(F.col("p_name"), F.when(k % 4 == 0, F.lit("; ")).otherwise(""), F.when(k % 4 == 0, F.upper("p_name")).otherwise("")),
        F.lit("name:uk"), F.when(k % 3 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(" "),
        F.lit("alt_name"), F.concat("p_type", F.lit(";;"), "p_name", F.lit(" ;"), "p_brand"),
    )
    return p.select("p_partkey", tags.alias("tags"))


@query("best_name", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 4 = 0 THEN p_name || '; ' || upper(p_name) ELSE p_name END AS name FROM part")
def best_name(spark, d):
    return _tags(spark, d).select("p_partkey", X.best_name("tags").alias("name"))


@query(
    "name_aliases",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '|' || p_brand || '|' || p_type ELSE p_name || '|' || p_type || '|' || p_brand END AS aliases FROM part""",
)
def name_aliases(spark, d):
    return _tags(spark, d).select("p_partkey", F.array_join(X.name_aliases("tags"), "|").alias("aliases"))


@query("first_non_empty", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS picked FROM part")
def first_non_empty(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    return p.select(
        "p_partkey",
        coalesce_text(F.when(k % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise("  "), F.when(k % 3 == 0, F.col("p_brand")), F.col("p_type")).alias("picked"),
    )


@query("prefer_existing", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS kept FROM part")
def prefer_existing(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    old, new = F.when(k % 2 == 0, F.col("p_name")).otherwise(" "), F.when(k % 3 == 0, F.col("p_brand"))
    return p.select("p_partkey", keep_old(old, new).alias("kept"))


@query(
    "search_text",
    "SELECT c_custkey, c_name || ', ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ', N' || c_nationkey ELSE '' END AS text FROM customer",
)
def search_text(spark, d):
    c = table(spark, d, "customer")
    third = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("N"), "c_nationkey")).otherwise(F.lower("c_mktsegment"))
    return c.select("c_custkey", X.search_text("c_name", F.concat("c_mktsegment", F.lit(" ")), F.lit(" "), third).alias("text"))


@query(
    "entity_key",
    f"""WITH s AS (SELECT p_partkey AS k, p_name AS n, {CLASS_SQL} AS c, {P.SQL_REGION.format(k='p_partkey')} FROM part)
SELECT k, CASE k % 4 WHEN 0 THEN 'osm:node:' || (k + 1) WHEN 1 THEN 'Prov:' || (k * 3) WHEN 2 THEN n || ':' || c || ':' || printf('%.0f', lng * 1000 + 0.25e0) || ':' || printf('%.0f', lat * 1000 + 0.25e0) ELSE n || ':' || c END AS entity_key FROM s""",
)
def entity_key(spark, d):
    p = P.with_region(part(spark, d), "p_partkey").withColumn("k", F.col("p_partkey"))
    k = F.col("k")
    key = X.entity_key(
        F.lit("node"), F.when(k % 4 == 0, k + 1).otherwise(0), F.when(k % 4 == 1, "Prov"), F.when(k % 4 == 1, (k * 3).cast("string")),
        "p_name", "place", F.when(k % 4 == 2, F.col("lng") * 1000 + 0.25), F.when(k % 4 == 2, F.col("lat") * 1000 + 0.25),
    )
    return p.select("k", key.alias("entity_key"))


@query("geometry_key", "SELECT count(DISTINCT (p_name, p_brand)) AS keys FROM part")
def geometry_key(spark, d):
    p = table(spark, d, "part").select(X.geometry_key("p_name", F.lit(32), "p_brand").alias("k"))
    return p.agg(F.count_distinct("k").alias("keys"))


@query(
    "split_list",
    "SELECT p_partkey, p_brand || '|' || p_name || '|' || p_type AS parts FROM part",
)
def split_list(spark, d):
    p = table(spark, d, "part")
    text = F.concat("p_name", F.lit(" ,,"), "p_type", F.lit("\r\n"), "p_brand", F.lit(" , "), F.upper("p_name"), F.lit("\n"))
    parts = Y.split_list(text)
    # three known parts, compared in a fixed order
    pick = lambda c: F.filter(parts, lambda v: v == F.col(c))
    return p.select("p_partkey", F.array_join(F.concat(pick("p_brand"), pick("p_name"), pick("p_type")), "|").alias("parts"))


@query("distinct_values", "SELECT lower(p_name) AS value_key, arg_min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, p_partkey) AS value FROM part GROUP BY 1")
def distinct_values(spark, d):
    p = table(spark, d, "part").withColumn("t", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return Y.distinct_values(p, "t", "p_partkey")


@query("find_duplicates", "SELECT lower(trim(text)) AS value_key, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY 1 HAVING count(*) > 1")
def find_duplicates(spark, d):
    return Y.find_duplicates(table(spark, d, "documents"), "text")


# ---- first rows and preferred candidates: line items as candidates of parts ----

CAND = """WITH c AS (SELECT l_partkey AS place_id, 'P' || (l_suppkey % 4) AS provider, CAST(l_suppkey % 3 AS VARCHAR) AS external_id, CAST(l_suppkey % 5 * 10 + 60 AS INTEGER) AS priority,
 CAST(CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE l_orderkey % 50 + 90 END AS INTEGER) AS score, l_shipdate AS updated_at, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS seq,
 CASE WHEN l_orderkey % 13 = 0 THEN ' ' ELSE 'ring' || l_suppkey END AS ring_text, l_linenumber = 3 AS rejected_by_containment, l_returnflag = 'R' AS rejected_by_geometry, 'reason ' || l_suppkey AS rejection_reason FROM lineitem)"""


def candidates(spark, d):
    li = table(spark, d, "lineitem")
    s, o = F.col("l_suppkey"), F.col("l_orderkey")
    return li.select(
        F.col("l_partkey").alias("place_id"), F.concat(F.lit("P"), s % 4).alias("provider"), (s % 3).cast("string").alias("external_id"),
        (s % 5 * 10 + 60).cast("int").alias("priority"), F.when(o % 4 == 0, 0).otherwise(o % 50 + 90).cast("int").alias("score"),
        F.col("l_shipdate").alias("updated_at"), ((o * 10 + F.col("l_linenumber")) * 100000 + s).alias("seq"),
        F.when(o % 13 == 0, " ").otherwise(F.concat(F.lit("ring"), s)).alias("ring_text"),
        (F.col("l_linenumber") == 3).alias("rejected_by_containment"), (F.col("l_returnflag") == "R").alias("rejected_by_geometry"),
        F.concat(F.lit("reason "), s).alias("rejection_reason"),
    )


OK = "trim(ring_text) <> '' AND NOT rejected_by_containment AND NOT rejected_by_geometry"
EFF = "CASE WHEN score <> 0 THEN score ELSE priority END"
GROUPS = CAND + f""", g AS (SELECT place_id, lower(provider) AS provider_key, lower(external_id) AS external_key, max({EFF}) AS group_score, max(updated_at) AS group_updated, max(priority) AS group_priority, count(*) AS members FROM c WHERE {OK} GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY group_score DESC, group_updated DESC, group_priority DESC, provider_key || chr(10) || external_key) AS rn FROM g)"""


@query("usable_candidate_filter", CAND + f" SELECT place_id, seq FROM c WHERE {OK}")
def usable_candidate_filter(spark, d):
    return candidates(spark, d).filter(R.usable_candidate()).select("place_id", "seq")


@query("effective_score", CAND + f" SELECT place_id, seq, CASE WHEN rejected_by_containment OR rejected_by_geometry THEN -2147483648 ELSE {EFF} END AS effective FROM c")
def effective_score(spark, d):
    bad = F.col("rejected_by_containment") | F.col("rejected_by_geometry")
    return candidates(spark, d).select("place_id", "seq", R.effective_score(rejected=bad).alias("effective"))


@query("candidate_groups", GROUPS + " SELECT place_id, provider_key, external_key, group_score, group_updated, group_priority, members FROM g")
def candidate_groups(spark, d):
    return R.candidate_groups(candidates(spark, d).filter(R.usable_candidate()))


@query("preferred_polygon", GROUPS + f" SELECT c.place_id, seq FROM c JOIN b ON rn = 1 AND b.place_id = c.place_id AND lower(provider) = provider_key AND lower(external_id) = external_key WHERE {OK}")
def preferred_polygon(spark, d):
    return R.preferred_polygon(candidates(spark, d)).select("place_id", "seq")


@query(
    "preferred_rings",
    GROUPS + f""" SELECT DISTINCT c.place_id, ring_text FROM c JOIN b ON rn = 1 AND b.place_id = c.place_id AND lower(provider) = provider_key AND lower(external_id) = external_key WHERE {OK}
 UNION SELECT p_partkey + 1000000, 'raw ' || p_partkey FROM part UNION SELECT p_partkey, 'raw ' || p_partkey FROM part WHERE p_partkey NOT IN (SELECT place_id FROM c)""",
)
def preferred_rings(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    raw = p.select(F.explode(F.array(F.struct(F.col("p_partkey").alias("place_id"), F.concat(F.lit("raw "), "p_partkey").alias("ring_text")),
                                     F.struct((F.col("p_partkey") + 1000000).alias("place_id"), F.concat(F.lit("raw "), "p_partkey").alias("ring_text")))).alias("r")).select("r.*")
    return R.preferred_rings(candidates(spark, d), raw)


@query("preferred_center", CAND + f", r AS (SELECT place_id, seq, row_number() OVER (PARTITION BY place_id ORDER BY {EFF} DESC, updated_at DESC, seq) AS rn FROM c) SELECT place_id, seq FROM r WHERE rn = 1")
def preferred_center(spark, d):
    return R.preferred_center(candidates(spark, d)).select("place_id", "seq")


@query("preferred_rejection", CAND + ", r AS (SELECT place_id, rejection_reason, row_number() OVER (PARTITION BY place_id ORDER BY priority DESC, updated_at DESC, seq) AS rn FROM c WHERE rejected_by_containment OR rejected_by_geometry) SELECT place_id, rejection_reason FROM r WHERE rn = 1")
def preferred_rejection(spark, d):
    return R.preferred_rejection(candidates(spark, d))


@query("first_usable_relation", CAND + ", r AS (SELECT place_id, seq, row_number() OVER (PARTITION BY place_id ORDER BY seq) AS rn FROM c WHERE NOT rejected_by_containment AND NOT rejected_by_geometry) SELECT place_id, seq FROM r WHERE rn = 1")
def first_usable_relation(spark, d):
    c = candidates(spark, d).withColumn("rejected", F.col("rejected_by_containment") | F.col("rejected_by_geometry"))
    return R.first_usable_relation(c, order="seq").select("place_id", "seq")


@query("first_match", CAND + ", r AS (SELECT place_id, seq, row_number() OVER (PARTITION BY place_id ORDER BY priority DESC, seq) AS rn FROM c) SELECT place_id, seq FROM r WHERE rn = 1")
def first_match(spark, d):
    return R.first_match(candidates(spark, d), ["place_id"], [F.col("priority").desc(), "seq"]).select("place_id", "seq")


@query(
    "dedupe_first_places",
    f"WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 500 <> 0 THEN 'node:' || (p_partkey % 500) ELSE lower(p_name || ':' || {CLASS_SQL}) END AS k FROM part) SELECT min(p_partkey) AS p_partkey FROM s GROUP BY k",
)
def dedupe_first_places(spark, d):
    k = F.col("p_partkey")
    p = part(spark, d).withColumns(
        {"osm_id": F.when(k % 3 == 0, k % 500).otherwise(0), "osm_type": F.lit("Node"), "name": F.col("p_name")}
    )
    return R.dedupe_first(p, R.place_key(), ["p_partkey"]).select("p_partkey")


@query("dedupe_first_relations", "SELECT min(l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey) AS row_key, l_suppkey % 40 AS relation_id FROM lineitem WHERE l_suppkey % 40 > 0 GROUP BY 2")
def dedupe_first_relations(spark, d):
    li = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10000000 + F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("row_key"), (F.col("l_suppkey") % 40).alias("relation_id")
    )
    return R.dedupe_first(li, F.col("relation_id").cast("string"), ["row_key"], F.col("relation_id") > 0)


@query("dedupe_first_areas", "SELECT min(p_partkey) AS p_partkey FROM part GROUP BY lower(p_name), p_partkey % 6, p_partkey % 4")
def dedupe_first_areas(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.lit("way").alias("osm_type"), F.lit(0).alias("osm_id"), F.col("p_name").alias("name"), (k % 6 + 0.25).alias("x"), (k % 4 + 0.25).alias("y"))
    return R.dedupe_first(p, R.area_key(), ["p_partkey"]).select("p_partkey")


@query("order_places", "SELECT p_partkey, upper(p_name) AS name FROM part")
def order_places(spark, d):
    p = part(spark, d).withColumn("name", F.upper("p_name"))
    return R.order_places(p, "p_partkey").select("p_partkey", "name")


@query("shuffle_rows", "SELECT event_id FROM events")
def shuffle_rows(spark, d):
    return R.shuffle_rows(table(spark, d, "events").select("event_id"), 7, "event_id")


@query(
    "feature_match_top1",
    f"""WITH f AS (SELECT l_partkey AS k, l_suppkey, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS seq, p_name, {CLASS_SQL} AS place, CAST(l_orderkey % 400 * 100 AS DOUBLE) AS dist, l_suppkey % 17 = 0 AS hit,
 CASE l_suppkey % 3 WHEN 0 THEN 'administrative.city' WHEN 1 THEN 'place.' || {CLASS_SQL} ELSE 'road' END AS cats, CASE WHEN l_orderkey % 3 = 0 THEN upper(p_name) ELSE 'other' END AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT *, CASE WHEN dist <= 3000 THEN 100 WHEN dist <= 15000 THEN 35 WHEN dist > 30000 THEN -100 ELSE 0 END + CASE WHEN hit THEN 120 ELSE 0 END + CASE WHEN lower(name) = p_name THEN 160 ELSE 0 END
 + CASE WHEN cats = 'administrative.city' THEN 50 ELSE -80 END + CASE WHEN contains(cats, place) THEN 20 ELSE 0 END AS score, cats = 'place.' || place OR cats = 'administrative.' || place AS typed FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY typed DESC, score >= 50 DESC, score DESC, seq) AS rn FROM s)
SELECT k, seq, CAST(score AS INTEGER) AS match_score FROM r WHERE rn = 1 AND score >= 50""",
)
def feature_match_top1(spark, d):
    p = part(spark, d).select("p_partkey", "p_name", "place")
    li = table(spark, d, "lineitem").select(*LI)
    f = li.join(p, li.l_partkey == p.p_partkey)
    s, o = F.col("l_suppkey"), F.col("l_orderkey")
    name = F.when(o % 3 == 0, F.upper("p_name")).otherwise("other")
    cats = F.when(s % 3 == 0, "administrative.city").when(s % 3 == 1, F.concat(F.lit("place."), "place")).otherwise("road")
    f = f.withColumns(
        {"k": F.col("l_partkey"), "seq": (o * 10 + F.col("l_linenumber")) * 100000 + s, "dist": (o % 400 * 100).cast("double"),
         "hit": s % 17 == 0, "cats": cats, "fname": name, "city": F.lit("elsewhere")}
    )
    score = R.feature_score("dist", "hit", "p_name", "place", "fname", "city", "fname", "cats")
    return R.feature_match_top1(f, "k", score, R.feature_is_typed("place", "cats"), ["seq"]).select("k", "seq", F.col("match_score").cast("int").alias("match_score"))


@query("link_tolerance", f"SELECT p_partkey, CASE {CLASS_SQL} WHEN 'city' THEN 2000e0 WHEN 'town' THEN 1000e0 WHEN 'village' THEN 500e0 WHEN 'hamlet' THEN 300e0 ELSE 200e0 END AS metres FROM part")
def link_tolerance(spark, d):
    return part(spark, d).select("p_partkey", rules.link_tolerance("place").alias("metres"))


@query("write_read_ring_text", "SELECT o_orderkey, CAST(3 + o_orderkey % 3 AS INTEGER) AS lenient, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(3 + o_orderkey % 3 AS INTEGER) END AS strict FROM orders")
def write_read_ring_text(spark, d):
    """Ring texts written from vertices, one in five with a bad pair, read back."""
    from geoloom.functions import rings as G

    o = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    ring = F.transform(F.sequence(F.lit(1).cast("bigint"), k % 3 + 3), lambda i: F.struct((k + i / 8).alias("x"), (k * 2 - i / 4).alias("y")))
    text = F.concat(G.ring_text(ring), F.when(k % 5 == 0, ";7,a").otherwise(""))
    o = o.withColumn("text", text)
    return o.select("o_orderkey", F.size(G.parse_ring_text("text")).alias("lenient"), F.when(G.parse_ring_text("text", True).isNotNull(), F.size(G.parse_ring_text("text", True))).alias("strict"))


@query(
    "ring_text_vertices",
    "SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS pos, o_orderkey + i / 8e0 AS x, o_orderkey * 2 - i / 4e0 AS y FROM orders, range(1, 6) t(i) WHERE i <= 3 + o_orderkey % 3",
)
def ring_text_vertices(spark, d):
    from geoloom.functions import rings as G

    k = F.col("o_orderkey")
    ring = F.transform(F.sequence(F.lit(1).cast("bigint"), k % 3 + 3), lambda i: F.struct((k + i / 8).alias("x"), (k * 2 - i / 4).alias("y")))
    o = table(spark, d, "orders").select("o_orderkey", G.ring_text(ring).alias("text"))
    return o.select("o_orderkey", F.posexplode(G.parse_ring_text("text")).alias("pos", "v")).select("o_orderkey", "pos", "v.x", "v.y")


@query(
    "drop_repeated_vertices",
    "SELECT o_orderkey, CAST(3 + o_orderkey % 3 AS INTEGER) AS kept FROM orders",
)
def drop_repeated_vertices(spark, d):
    from geoloom.functions import rings as G

    k = F.col("o_orderkey")
    base = F.transform(F.sequence(F.lit(1).cast("bigint"), k % 3 + 3), lambda i: F.struct((i * i).cast("double").alias("x"), (i * 3).cast("double").alias("y")))
    doubled = F.flatten(F.transform(base, lambda p: F.array(p, F.struct((p["x"] + 0.005).alias("x"), p["y"].alias("y")))))
    closed = F.concat(doubled, F.slice(base, 1, 1))
    return table(spark, d, "orders").select("o_orderkey", F.size(G.drop_repeated(closed)).alias("kept"))
