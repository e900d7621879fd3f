"""Queries of single rules and operators that no larger query exercises alone."""

from __future__ import annotations

import difflib

from pyspark.sql import functions as F

from tessella.functions import similarity, text
from tessella.functions.spreading import spread
from tessella.operators import extraction, languages, ledger, models, nodes, pairwise, places, requests, sampling, sequences, services
from tessella.plans.catalogue import customers_placed, suppliers_placed
from tessella.plans.registry import T, joined, query
from tessella.sources import clients
from tessella.sources.scratch import work_folder
from tessella.streaming import resume


def blank():
    return F.lit(None).cast("string")


# ---- names and numbers


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Site' || p_size WHEN 1 THEN 'Site' || p_size ELSE p_name END AS field FROM part")
def field_names(s, d):
    size = F.concat(F.lit("Site"), "p_size")
    given = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit("_tab"))).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit("_nesttab"))).otherwise(F.col("p_name"))
    return T(s, d, "part").select("p_partkey", text.plain_field_name(given).alias("field"))


@query(r"""SELECT o_orderkey, lower(trim(o_orderpriority)) AS plain, lower(trim(regexp_replace('  ' || o_orderpriority || '   X ', '\s+', ' ', 'g'))) AS packed, CASE WHEN o_orderkey % 4 > 0 THEN round(o_totalprice, 2) END AS number,
                  CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status FROM orders""")
def text_forms(s, d):
    price = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit(" "), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"), F.lit(" "))).otherwise(F.lit("1.5 kg"))
    status = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" "), "o_orderstatus")).otherwise("   ")
    return T(s, d, "orders").select(
        "o_orderkey", text.normalized(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("plain"), text.collapsed(F.concat(F.lit("  "), "o_orderpriority", F.lit("   X "))).alias("packed"),
        text.number(price).alias("number"), text.blank_to_null(status).alias("status"),
    )


def known_types() -> list[str]:
    return ["standard", "medium", "economy", "promo", "large", "small"]


def ratio_values() -> str:
    """Ratios of the parts' types to the same without their e's, as the library has them."""
    made = [(a, b, difflib.SequenceMatcher(None, a, b).ratio()) for a in known_types() for b in (x.replace("e", "") for x in known_types())]
    return ", ".join(f"('{a}', '{b}', {r!r})" for a, b, r in made)


FUZZY_SQL = f"""WITH r(a, b, similarity) AS (VALUES {ratio_values()}), x AS (SELECT DISTINCT lower(p_type) AS a FROM part), y AS (SELECT DISTINCT lower(replace(p_type, 'E', '')) AS b FROM part)
  SELECT a AS left_name, b AS right_name, round(similarity::DOUBLE, 6) AS similarity FROM r JOIN x USING (a) JOIN y USING (b) WHERE similarity >= 0.85"""


@query(FUZZY_SQL)
def fuzzy_name_match(s, d):
    part = T(s, d, "part")
    made = similarity.similar_names(part.select(F.col("p_type").alias("name")), part.select(F.replace("p_type", F.lit("E"), F.lit("")).alias("name")), 0.85)
    return made.withColumn("similarity", F.round("similarity", 6))


# ---- places


LEV = lambda a, b: f"(1 - levenshtein(lower({a}), lower({b})) / greatest(length({a}), length({b})))"
PLACED_SQL = f"""SELECT c_custkey, s_suppkey, sqrt((c_acctbal / 1000 - s_acctbal / 1000) ** 2 + (c_nationkey - s_nationkey) ** 2) AS distance, {LEV('c_name', 's_name')} AS names,
                 round(100 * (5 * {LEV('c_mktsegment', 's_name')} + 10 * {LEV('c_name', 's_name')} + 25 * 0.1) / 40.0, 1) AS score
  FROM customer, supplier WHERE sqrt((c_acctbal / 1000 - s_acctbal / 1000) ** 2 + (c_nationkey - s_nationkey) ** 2) <= 0.25"""


def leveled(continent, country, locality):
    return dict(zip(places.LEVELS, (continent, country, F.lit(""), F.lit(""), F.lit(""), locality), strict=True))


@query(f"SELECT c_custkey, s_suppkey, score, CASE WHEN score + 60 >= 90 AND (distance * 111000 < 100 OR names > 0.95) THEN 'exact' WHEN score + 60 >= 60 THEN 'near' ELSE 'none' END AS class FROM ({PLACED_SQL})")
def match_scores(s, d):
    name = similarity.canonical
    customers = customers_placed(s, d).select("c_custkey", "x", "y", F.lower("c_name").alias("lower"), name(F.col("c_name")).alias("c_name"), name(F.col("c_mktsegment")).alias("c_mktsegment"))
    suppliers = suppliers_placed(s, d).select("s_suppkey", "x", "y", F.lower("s_name").alias("lower"), name(F.col("s_name")).alias("s_name"))
    near = places.near(customers, suppliers, "x", "y", 0.25)
    own, record = leveled(F.col("l.c_mktsegment"), F.col("l.c_name"), F.col("l.c_name")), leveled(F.col("r.s_name"), F.col("r.s_name"), F.lit(""))
    score = places.match_score(own, record, similarity.by_levenshtein, told=True)
    rows = near.select("l.c_custkey", "r.s_suppkey", "distance", score.alias("score"), similarity.by_levenshtein(F.col("l.lower"), F.col("r.lower")).alias("names"))
    return rows.select("c_custkey", "s_suppkey", "score", places.match_class(F.col("score") + 60, F.col("distance") * places.METRES, F.col("names")).alias("class"))


@query(f"""SELECT c_custkey, s_suppkey, score, CASE WHEN score >= 90 AND NOT lower_data THEN 'perfect' WHEN score >= 60 THEN 'partial' ELSE 'climb' END AS class FROM (
             SELECT c_custkey, s_suppkey, s_suppkey % 3 = 0 AS lower_data, round(p * CASE WHEN s_suppkey % 3 = 0 THEN 0.7 ELSE 1 END, 1) AS score FROM (
               SELECT c_custkey, s_suppkey, round(100 * (5.0 + 15 * {LEV('c_name', 's_name')}) / 20.0, 1) AS p FROM customer JOIN supplier ON c_nationkey = s_nationkey))""")
def parent_scores(s, d):
    name = similarity.canonical
    customers = spread(T(s, d, "customer")).select("c_custkey", "c_nationkey", name(F.col("c_nationkey").cast("string")).alias("own_country"), name(F.col("c_name")).alias("own_name"))
    below = F.when(F.col("s_suppkey") % 3 == 0, "a place").otherwise("")
    suppliers = T(s, d, "supplier").select("s_suppkey", "s_nationkey", name(F.col("s_nationkey").cast("string")).alias("country"), name(F.col("s_name")).alias("name"), below.alias("below"))
    rows = customers.join(suppliers, F.col("c_nationkey") == F.col("s_nationkey"))
    own, record = [F.col("own_country"), F.col("own_name")], [F.col("country"), F.col("name"), F.col("below")]
    score = places.parent_score(own, record, places.PARENT_WEIGHTS, 1, similarity.by_levenshtein, told=True)
    return rows.select("c_custkey", "s_suppkey", score.alias("score")).withColumn("class", places.parent_class(F.col("score"), F.col("s_suppkey") % 3 == 0))


@query("SELECT c_custkey, s_suppkey::VARCHAR AS irn FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey::VARCHAR) <= 5")
def named_nodes(s, d):
    # Of a country's records only those without a site number and without anything below may be the node.
    names = T(s, d, "customer").select("c_custkey", F.md5(F.col("c_nationkey").cast("string")).alias("country"), F.lit("here").alias("continent"))
    records = T(s, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("irn"), F.lit("HERE").alias("continent"), F.md5(F.col("s_nationkey").cast("string")).alias("country"), F.when(F.col("s_suppkey") % 2 > 0, "p").alias("province"),
        *(blank().alias(c) for c in ("district", "township", "locality")), F.when(F.col("s_suppkey") % 3 == 0, "S1").alias("site_number"),
    )
    found = places.match_node(names.select("country", "continent").distinct(), records, "country", ["continent"], "irn", "site_number", threshold=0.99, native=True)
    return names.join(found, F.col("left_name") == F.col("country")).select("c_custkey", "irn")


@query("""SELECT c_custkey, s_suppkey, 100.0::DOUBLE AS score, 1.0::DOUBLE AS field_similarity FROM customer JOIN supplier ON c_nationkey = s_nationkey
          WHERE s_suppkey IN (SELECT s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 20) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey) <= 10""")
def sites_by_name(s, d):
    level = lambda key: [F.md5(F.col(key).cast("string")).alias("country"), *(blank().alias(c) for c in places.LEVELS if c != "country")]
    sites, records = T(s, d, "customer").select("c_custkey", *level("c_nationkey")), T(s, d, "supplier").select("s_suppkey", *level("s_nationkey"))
    return places.match_by_name(sites, records, "c_custkey", "s_suppkey", "country", threshold=0.99, native=True).select("c_custkey", "s_suppkey", "score", "field_similarity")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN -1 WHEN c_custkey % 5 = 1 THEN 0 ELSE 5 END AS level, c_custkey % 5 < 2 AS no_lower FROM customer")
def level_rules(s, d):
    key = F.col("c_custkey") % 5
    rows = T(s, d, "customer").select("c_custkey", F.when(key == 1, F.col("c_name")).alias("continent"), *(blank().alias(c) for c in places.LEVELS[1:5]), F.when(key > 1, "a place").otherwise(" ").alias("locality"))
    return rows.select("c_custkey", places.most_precise([F.col(c) for c in places.LEVELS]).alias("level"), places.no_lower(0).alias("no_lower"))


@query("SELECT p_partkey, p_type FROM part WHERE p_size % 3 = 1 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 3 = 2")
def rank_rejects(s, d):
    rank = F.when(F.col("p_size") % 3 == 0, "City").when(F.col("p_size") % 3 == 1, F.col("p_type"))
    return nodes.rejected_ranks(T(s, d, "part").select("p_partkey", rank.alias("p_type")), "p_type")


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 7 = 0 THEN 999 ELSE c_acctbal / 100 END, c_custkey)::INT AS position FROM customer")
def distance_order(s, d):
    rows = T(s, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal") / 100).alias("km"))
    return nodes.by_distance(rows, "c_nationkey", "km", "c_custkey").drop("km")


# ---- papers


@query("SELECT event_id, '{\"k\": ' || json_extract_string(props, '$.k') || ', \"t\": \"' || event_type || '\"}' AS data, event_id % 4 > 0 AS repaired FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 4 = 3")
def json_repair(s, d):
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    whole = F.concat(F.lit('{"t": "'), "event_type", F.lit('", "k": '), k, F.lit("}"))
    fenced = F.concat(F.lit("```json\n{'t': '"), "event_type", F.lit("', 'k': "), k, F.lit(",}\n```"))
    cut = F.concat(F.lit('{k: '), k, F.lit(', "t": "'), "event_type", F.lit('"'))
    rows = T(s, d, "events").select("event_id", F.when(n == 0, whole).when(n == 1, fenced).when(n == 2, cut).otherwise("no object").alias("t"))
    made = rows.select("event_id", extraction.repaired_json(F.col("t")).alias("j")).select("event_id", "j.data", "j.repaired")
    return made


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 4 THEN 'error' WHEN event_id % 5 = 3 THEN 'failed_validation' WHEN event_id % 5 = 2 THEN 'repaired'
            WHEN json_extract_string(props, '$.k')::INT > 50 THEN 'failed_validation' ELSE 'valid' END AS status FROM events) GROUP BY status""")
def cleaning(s, d):
    n = F.col("event_id") % 5
    spec = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "enum": list(range(51))}}}
    whole = F.when(n == 3, "nothing").when(n == 2, F.concat(F.lit("{'k': 1,}"))).otherwise(F.col("props"))
    rows = T(s, d, "events").select(F.when(n == 4, "error").otherwise("success").alias("status"), extraction.repaired_json(whole).alias("j"))
    made = rows.select(extraction.cleaned_status(F.col("status"), F.col("j.data").isNotNull(), F.col("j.repaired"), extraction.schema_error(F.col("j.data"), spec), strict=True).alias("status"))
    return made.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'Title:' || chr(10) || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || p_type ELSE '' END AS prompt FROM part")
def prompts(s, d):
    return T(s, d, "part").select("p_partkey", extraction.prompt([("Title:", F.col("p_name")), ("", F.when(F.col("p_size") % 2 == 0, F.col("p_type"))), ("Criteria:", F.lit("")), ("Examples:", None)]).alias("prompt"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
def trial_rows(s, d):
    return services.first_rows(T(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 5)


LANGUAGE_SQL = "VALUES " + ", ".join(f"({i}, '{code}', [{', '.join(map(repr, words))}])" for i, (code, words) in enumerate(sorted(text.LANGUAGE_WORDS.items())))


@query(rf"""WITH l(i, code, words) AS ({LANGUAGE_SQL}), w AS (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS ws FROM documents),
  v AS (SELECT doc_id, code, i, len(list_filter(ws, lambda x: list_contains(words, x))) AS n FROM w, l WHERE length(trim(text)) >= 40),
  b AS (SELECT doc_id, code FROM v WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1)
  SELECT doc_id, code AS told FROM documents LEFT JOIN b USING (doc_id)""")
def language_told(s, d):
    return T(s, d, "documents").select("doc_id", text.language(F.col("text")).alias("told"))


@query(r"""WITH w AS (SELECT doc_id, lang, length(trim(text)) >= 40 AS enough, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS word FROM documents),
  c AS (SELECT doc_id, lang, enough, '_' || word || '_' AS m FROM w),
  g AS (SELECT doc_id, lang, enough, n AS size, substr(m, i::INT, n::INT) AS gram FROM c, range(1, 4) t(n), LATERAL (SELECT unnest(range(1, length(m) - n + 2)) AS i)),
  k AS MATERIALIZED (SELECT lang, gram, any_value(size) AS size, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY lang, gram),
  h AS (SELECT DISTINCT gram, size FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM k) WHERE r <= 1500),
  t AS (SELECT lang, size, sum(n) AS total FROM k GROUP BY lang, size), v AS (SELECT size, count(*) AS kinds FROM h GROUP BY size),
  p AS MATERIALIZED (SELECT h.gram, t.lang, round(1000 * ln((coalesce(k.n, 0) + 0.5) / (t.total::DOUBLE + 0.5 * v.kinds)))::BIGINT AS weight
    FROM h JOIN t ON t.size = h.size JOIN v ON v.size = h.size LEFT JOIN k ON k.lang = t.lang AND k.gram = h.gram),
  s AS (SELECT d.doc_id, p.lang, sum(d.n * p.weight) AS score FROM (SELECT doc_id, gram, count(*) AS n FROM g WHERE enough GROUP BY doc_id, gram) d JOIN p USING (gram) GROUP BY ALL),
  b AS (SELECT doc_id, lang AS told FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)
  SELECT doc_id, told FROM documents LEFT JOIN b USING (doc_id)""")
def language_profiles(s, d):
    """Languages by n-gram profiles of all labelled documents."""
    docs = T(s, d, "documents").select("doc_id", "text", "lang")
    return languages.told(docs, "doc_id", "text", *languages.fit(docs, "text", "lang"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' END END AS model,
                 CASE p_size % 3 WHEN 0 THEN 'full_page' WHEN 1 THEN 'region' END AS strategy,
                 CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 2 THEN 'unknown backend none' WHEN p_size % 3 = 0 AND p_size % 7 = 0 THEN 'no api key' WHEN p_size % 3 = 1 AND p_size % 7 = 1 THEN 'no host' END AS stops FROM part""")
def backends(s, d):
    size = F.col("p_size")
    backend = F.when(size % 3 == 0, "hosted").when(size % 3 == 1, "regions").otherwise("none")
    model = services.model_of(F.when(size % 3 == 0, "a").when(size % 3 == 1, "b"), F.when(size % 2 == 0, F.col("p_type")).otherwise(" "), {"a": "small", "b": "large"})
    stops = services.preflight(backend, F.when(size % 7 != 1, "h"), F.when(size % 7 != 0, "k"), size % 5 != 0)
    return T(s, d, "part").select("p_partkey", model.alias("model"), services.plan_of(backend)["strategy"].alias("strategy"), stops.alias("stops"))


@query("SELECT p_partkey, greatest(1, p_size // 4)::INT AS jobs, 4 * p_size <= p_partkey AS fits FROM part")
def machine_plan(s, d):
    return T(s, d, "part").select("p_partkey", services.jobs_for(F.col("p_size"), F.lit(4)).alias("jobs"), services.fits_machine(F.lit(4), F.col("p_size"), F.col("p_partkey")).alias("fits"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 > 0 THEN 'nation ' || c_nationkey END AS taxon, CASE WHEN c_nationkey % 3 = 2 THEN c_nationkey + 1 END AS level, NULL::VARCHAR AS unknown FROM customer""")
def registered_services(s, d):
    @services.register("taxa")
    def taxa(value, parameters):
        n = int(value)
        return None if n % 3 == 0 else {"name": f"{parameters['prefix']} {n}", "level": n + 1 if n % 3 == 2 else None}

    config = [{"field": "nation", "api": "taxa", "output_field": "found", "extra_params": {"prefix": "nation"}}, {"field": "nation", "api": "no such service", "output_field": "other"}]
    rows = T(s, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    made = services.enriched_by(rows, config, {"taxa": "name string, level int"})
    return made.select("c_custkey", F.col("found.name").alias("taxon"), "found.level", F.col("other.found").alias("unknown"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 > 0 THEN 'nation ' || c_nationkey END AS taxon, CASE WHEN c_nationkey % 3 = 2 THEN c_nationkey + 1 END AS level, upper(c_mktsegment) AS segment,
    CASE WHEN c_nationkey % 3 > 0 THEN 'other ' || c_nationkey END AS other, NULL::VARCHAR AS unknown, string_agg(coalesce('key ' || k, '-'), ',' ORDER BY i) AS keys
  FROM customer, (VALUES (0), (1), (2)) v(i), LATERAL (SELECT CASE WHEN (c_custkey + i) % 3 > 0 THEN (c_custkey + i) % 100 END AS k) GROUP BY ALL""")
def table_of_services(s, d):
    """Five mappings, one of them into an array's elements, through one table function."""

    def taxa(value, parameters):
        n = int(value)
        return None if n % 3 == 0 else {"name": f"{parameters['prefix']} {n}", "level": n + 1 if n % 3 == 2 else None}

    extra = lambda prefix: {"extra_params": {"prefix": prefix}}
    config = [
        {"field": "nation", "api": "taxa", "output_field": "found", **extra("nation")}, {"field": "nation", "api": "taxa", "output_field": "again", **extra("other")},
        {"field": "c_mktsegment", "api": "segments", "output_field": "seg"}, {"field": "nation", "api": "no such service", "output_field": "nothing"}, {"field": "records.k", "api": "keys", "output_field": "key"},
    ]
    record = lambda i: F.struct(F.when((F.col("c_custkey") + i) % 3 > 0, (F.col("c_custkey") + i) % 100).alias("k"), F.lit(i).alias("i"))
    rows = T(s, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"), F.array(*map(record, range(3))).alias("records"))
    calls = {"taxa": taxa, "segments": lambda value, _: {"segment": value.upper()}, "keys": lambda value, _: {"key": f"key {value}"}}
    made = services.enriched_all(rows, config, {"taxa": "name string, level int", "segments": "segment string", "keys": "key string"}, calls)
    keys = F.array_join(F.transform("records", lambda r: F.coalesce(r["key"]["key"], F.lit("-"))), ",")
    return made.select("c_custkey", F.col("found.name").alias("taxon"), "found.level", "seg.segment", F.col("again.name").alias("other"), F.col("nothing.found").alias("unknown"), keys.alias("keys"))


# ---- resuming


def flaky(fails: dict):
    """A service: keys of remainder 0 by 5 fail always, of 1 twice before they succeed; others answer at once."""

    def call(row):
        key = row["c_custkey"]
        fails[key] = fails.get(key, 0) + 1
        if key % 5 == 0 or (key % 5 == 1 and fails[key] < 3):
            raise OSError("busy")
        if key % 5 == 2:
            raise ValueError("not to be tried again")
        return {"answer": f"a{key}", "attempts": fails[key]}

    return call


@query("SELECT c_custkey, 'a' || c_custkey AS answer, CASE WHEN c_custkey % 5 = 1 THEN 3 WHEN c_custkey % 5 IN (0, 2) THEN 9 ELSE 1 END AS attempts FROM customer")
def resumed_calls(s, d):
    todo, at = T(s, d, "customer").select("c_custkey"), work_folder(s, "results")
    resume.resume(todo, at, "c_custkey", flaky({}), "answer string, attempts int", wait=0.0)
    # What failed is not kept; the next run asks for that alone, and the service has recovered.
    return resume.resume(todo, at, "c_custkey", lambda row: {"answer": f"a{row['c_custkey']}", "attempts": 9}, "answer string, attempts int", wait=0.0).drop("status")


@query("SELECT c_custkey, 'first ' || c_mktsegment AS answer, CASE WHEN c_nationkey % 3 > 0 THEN (CASE WHEN c_nationkey < 12 THEN 'first ' ELSE 'second ' END) || c_nationkey END AS other FROM customer")
def cached_lookups(s, d):
    """Segments and nations looked up in two runs each over one cache: what the first run has had answered is not asked for again."""
    at = work_folder(s, "lookups")
    say = lambda word, most: lambda value, _: None if value.isdigit() and (int(value) % 3 == 0 or int(value) >= most) else {"answer": f"{word} {value}"}
    rows = T(s, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    for word, most in (("first", 12), ("second", 1000)):
        out = extraction.enriched(rows, "c_mktsegment", "a", say(word, most), "answer string", cache=f"{at}/segments")
        out = extraction.enriched(out, "nation", "b", say(word, most), "answer string", cache=f"{at}/nations")
    return out.select("c_custkey", F.col("a.answer").alias("answer"), F.col("b.answer").alias("other"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 2) THEN 'error' ELSE 'success' END AS status, CASE c_custkey % 5 WHEN 0 THEN 'busy' WHEN 2 THEN 'not to be tried again' END AS error FROM customer")
def retried_calls(s, d):
    made = resume.called(T(s, d, "customer").select("c_custkey"), flaky({}), "answer string, attempts int", wait=0.0, pause=0.0)
    return made.select("c_custkey", "status", "error")


@query("SELECT c_custkey, ((k - 1) // 5)::INT AS batch, ((k - 1) // 20)::INT AS send_window FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer)")
def send_windows(s, d):
    return resume.windows_of(T(s, d, "customer").select("c_custkey"), ["c_custkey"])


# ---- samples


@query("""WITH t AS (SELECT doc_id, greatest(1, n_chars // 60) AS pages FROM documents), x AS (SELECT doc_id, pages, CASE WHEN pages > 4 THEN 2 ELSE 0 END AS a FROM t)
  SELECT doc_id, array_to_string(list_sort(CASE WHEN pages - a <= 10 THEN range(a, pages) ELSE list_distinct(list_transform(range(0, 10), lambda i: a + i * (pages - a) // 10)) END), ',') AS picked FROM x""")
def page_picks(s, d):
    pages = F.greatest(F.lit(1), F.floor(F.col("n_chars") / 60)).cast("int")
    return T(s, d, "documents").select("doc_id", joined(F.sort_array(sampling.spaced(pages))).alias("picked"))


@query("SELECT o_orderkey, o_orderkey < 10 OR (o_orderkey - 10) % greatest(1, (n - 10) // 10) = 0 AS looked_at FROM orders, (SELECT count(*) AS n FROM orders)")
def language_pages(s, d):
    from tessella.operators import pages

    n = T(s, d, "orders").agg(F.count("*").alias("n"))
    return T(s, d, "orders").crossJoin(n).select("o_orderkey", pages.language_sampled(F.col("o_orderkey"), F.col("n")).alias("looked_at"))


# ---- sequences


@query("""SELECT s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey < b.s_suppkey AND (a.s_suppkey < 10) <> (b.s_suppkey < 10)""")
def outgroup_pairs(s, d):
    rows = T(s, d, "supplier").select("s_nationkey", "s_suppkey", F.md5("s_name").alias("seq"))
    return sequences.outgroup_pairs(rows, ["s_nationkey"], "s_suppkey", "seq", list(range(10))).select("s_nationkey", "a", "b")


@query("""WITH p AS (SELECT s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey < b.s_suppkey), n AS (SELECT count(*) AS taxa FROM supplier)
          SELECT a, b FROM p ORDER BY md5('42:' || a || '-' || b), a || '-' || b LIMIT (SELECT 4 * taxa FROM n)""")
def random_pairs(s, d):
    rows = T(s, d, "supplier").select("s_nationkey", "s_suppkey")
    taxa = rows.agg(sampling.default_pairs(F.count("*")).alias("n")).first().n
    return pairwise.sampled(rows, ["s_nationkey"], "s_suppkey", taxa)


@query("SELECT lang, count(*) FILTER (length(text) < 100) AS short_loci, round(avg(length(text)), 2) AS mean_length FROM documents GROUP BY lang")
def short_loci(s, d):
    return sequences.short_loci(T(s, d, "documents"), "lang", "text", 100)


@query("SELECT count(*) AS loci, round(avg(round(coalesce(100.0 * (length(text) - length(k)) / nullif(length(text), 0), 0), 2)), 2) AS percent_mean, round(avg(length(k)), 2) AS mean_trimmed_length FROM (SELECT text, regexp_replace(text, '\\s+', ' ', 'g') AS k FROM documents)")
def trim_means(s, d):
    rows = T(s, d, "documents").select("doc_id", "text", F.regexp_replace("text", r"\s+", " ").alias("k"))
    return sequences.trim_totals(sequences.trim_summary(rows, "doc_id", "text", "k")).select("loci", "percent_mean", "mean_trimmed_length")


@query("SELECT n_regionkey, count(*) FILTER (n_nationkey % 3 = 0) AS n_free FROM nation GROUP BY n_regionkey")
def free_parameter_counts(s, d):
    rows = T(s, d, "nation").select("n_regionkey", F.when(F.col("n_nationkey") % 3 == 0, "free").otherwise("fixed").alias("type"))
    return models.free_parameters(rows, "n_regionkey")


# ---- ledgers and requests


@query("SELECT o_orderkey, o_orderkey || '||' || o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m-%d') AS line FROM orders")
def pipe_rows(s, d):
    return T(s, d, "orders").select("o_orderkey", ledger.pipe_row([F.col("o_orderkey"), blank(), F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd")]).alias("line"))


@query("SELECT c_custkey, c_custkey % 4 = 0 AS asks, CASE WHEN c_custkey % 4 > 0 THEN md5(c_nationkey::VARCHAR) END AS source FROM customer")
def funding_sources(s, d):
    account = F.when(F.col("c_custkey") % 4 == 0, "To be determined (ask)").otherwise(F.concat(F.lit(" "), F.upper(F.md5(F.col("c_nationkey").cast("string")))))
    rows = T(s, d, "customer").select("c_custkey", account.alias("account"), requests.needs_funding(account).alias("asks"))
    sources = T(s, d, "nation").select(F.md5(F.col("n_nationkey").cast("string")).alias("name"))
    return requests.funding(rows, sources, "account", threshold=0.95).select("c_custkey", "asks", "source")


@query("SELECT o_orderkey, (1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey))::INT AS receipt_seq FROM orders WHERE o_orderstatus = 'P'")
def new_receipts(s, d):
    new = T(s, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    return ledger.numbered_after(new, ["o_orderdate", "o_orderkey"], 1000).select("o_orderkey", "receipt_seq")


# ---- services


def answering(service: str):
    """A stand-in for a service: what it would answer, told by the address."""

    def fetch(url, body, headers):
        import urllib.parse as u

        at = u.urlsplit(url)
        asked = dict(u.parse_qsl(at.query))
        if service == "taxon":
            n = int(asked["name"].rsplit("_", 1)[1])
            return {"matchType": "NONE"} if n % 4 == 0 else {"matchType": "EXACT", "canonicalName": asked["name"].title(), "rank": "SPECIES", "usageKey": n * 7}
        if service == "place":
            return {"geonames": [] if asked.get("country") != "XX" else [{"name": asked["q"], "countryCode": "XX", "lat": "1.5", "geonameId": len(asked["q"])}]}
        if service == "compound":
            return {"PC_Compounds": [{"id": {"id": {"cid": len(u.unquote(at.path))}}, "props": [{"value": {"sval": "H2O"}}]}]}
        if service == "gene":
            return {"esearchresult": {"idlist": [asked["term"]]}}
        return [{"display_name": asked["q"], "lat": "1", "lon": "2"}] if service == "address" else {"results": [{"name": asked["query"], "wfoId": "w1"}]}

    return fetch


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 4 > 0 THEN 'Nation_' || c_nationkey END AS taxon, CASE WHEN c_nationkey % 4 > 0 THEN (c_nationkey * 7)::VARCHAR END AS taxon_id, 'NATION_' || c_nationkey AS plant,
                 'NATION_' || c_nationkey AS place, NULL::VARCHAR AS unasked, '1' AS latitude, (length('/rest/pug/compound/name/NATION_' || c_nationkey || '/JSON'))::VARCHAR AS cid, 'H2O' AS formula, 'NATION_' || c_nationkey || '[Gene Name] AND mouse[Organism]' AS gene FROM customer""")
def service_clients(s, d):
    rows = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    for name in clients.SERVICES:
        services.register(name)(clients.lookup_of(name, answering(name)))
    schemas = {name: clients.schema_of(name) for name in clients.SERVICES}
    extra = {"place": {"username": "someone", "country": "XX"}, "gene": {"organism": "mouse"}}
    config = [{"field": "n_name", "api": name, "output_field": f"x_{name}", "extra_params": extra.get(name)} for name in clients.SERVICES]
    made = services.enriched_by(rows, [*config, {"field": "n_name", "api": "place", "output_field": "x_bare"}], schemas)
    return made.select(
        "c_custkey", F.col("x_taxon.matched_name").alias("taxon"), F.col("x_taxon.gbif_id").alias("taxon_id"), F.col("x_plant.matched_name").alias("plant"), F.col("x_place.matched_name").alias("place"), F.col("x_bare.matched_name").alias("unasked"),
        "x_address.latitude", "x_compound.cid", F.col("x_compound.molecular_formula").alias("formula"), F.col("x_gene.gene_id").alias("gene"),
    )


@query("SELECT n_nationkey, kind, CASE kind WHEN 'chat' THEN 'chat reads ' ELSE 'generate reads ' END || n_name AS text FROM nation, (VALUES ('chat'), ('generate')) AS k(kind)")
def page_readers(s, d):
    """Pages read by both forms of service, through stand-ins that answer what was sent."""

    def generate(url, body, headers):
        return {"response": f"{url.rsplit('/', 1)[1]} reads {body['images'][0]}"}

    def chat(url, body, headers):
        sent = body["messages"][0]["content"][0]["image_url"]["url"]
        return {"choices": [{"message": {"content": f"{url.split('/')[-2]} reads {sent.split(',')[1]}"}}]}

    rows, at = T(s, d, "nation").select("n_nationkey", F.col("n_name").alias("image")), work_folder(s, "pages-read")
    made = None
    for kind, fetch in (("generate", generate), ("chat", chat)):
        one = resume.resume(rows, f"{at}/{kind}", "n_nationkey", clients.page_reader(kind, "host:1", "m", "read this", fetch), "text string", wait=0.0).select("n_nationkey", F.lit(kind).alias("kind"), "text")
        made = one if made is None else made.unionByName(one)
    return made


@query("SELECT p_partkey, 'said of ' || p_name AS text, length(p_name)::INT AS input_tokens FROM part")
def model_extraction(s, d):
    """A language model's reading of documents, through a stand-in."""

    def call(row):
        body = clients.extraction_request("m", "extract", row["p_name"])
        held = body["messages"][0]["content"][0]["source"]["data"]
        return clients.extraction_answer({"content": [{"text": f"said of {held}"}], "usage": {"input_tokens": len(held), "output_tokens": 1}})

    made = resume.called(T(s, d, "part").select("p_partkey", "p_name"), call, "text string, input_tokens int, output_tokens int", wait=0.0, rate=1e6, tasks=2)
    return made.where("status = 'success'").select("p_partkey", "text", "input_tokens")
