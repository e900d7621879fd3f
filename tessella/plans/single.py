"""Queries of single rules over the content of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import extraction, models, nodes, pages, pairwise, requests, scoring, sequences
from tessella.plans.registry import T, query
from tessella.sources.scratch import work_folder, write_text
from tessella.sources.sequences import newick_tips, read_matrix


def pick(c, *values):
    """The value that a number's remainder names."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(c % len(values) == i, F.lit(v)).otherwise(out)
    return out


def pick_sql(c, *values):
    return "CASE " + " ".join(f"WHEN {c} % {len(values)} = {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


PLACES = ("city", "town", "county", None, "suburb", None, None)
CATEGORIES, KINDS = ("boundary", "leisure", "boundary", "highway"), ("administrative", "park", "protected_area")
COUNTRIES = (("A", "us"), ("N", "fr"), ("R", "zz"))


@query(f"""WITH r AS (SELECT l_orderkey, ((l_linenumber * 10000000 + l_partkey) * 100000 + l_suppkey) * 100 + l_quantity::INT AS line, {pick_sql("l_partkey", *PLACES)} AS place, {pick_sql("l_suppkey", *CATEGORIES)} AS category, {pick_sql("l_partkey", *KINDS)} AS kind,
    (l_quantity::INT % 10) AS level, l_returnflag AS f FROM lineitem),
  k AS (SELECT *, CASE place WHEN 'city' THEN 'City' WHEN 'town' THEN 'Town' WHEN 'county' THEN 'County' ELSE
    CASE WHEN (category = 'boundary' AND kind = 'protected_area') OR (category = 'leisure' AND kind = 'park') THEN 'LMA' WHEN category = 'boundary' AND kind = 'administrative' THEN
      CASE WHEN level = 2 THEN 'Country' WHEN f = 'A' THEN CASE level WHEN 4 THEN 'State' WHEN 6 THEN 'County' WHEN 7 THEN 'City' WHEN 8 THEN 'City' END
        WHEN f = 'N' THEN CASE level WHEN 4 THEN 'Region' WHEN 6 THEN 'Department' WHEN 7 THEN 'Arrondissement' WHEN 8 THEN 'City' END
        ELSE CASE level WHEN 3 THEN 'Region' WHEN 4 THEN 'State' WHEN 5 THEN 'Region' WHEN 6 THEN 'County' WHEN 7 THEN 'Municipality' WHEN 8 THEN 'City' END END END END AS rank FROM r),
  n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY line) AS i, count(*) OVER (PARTITION BY l_orderkey) AS candidates FROM k WHERE rank IS NOT NULL),
  v AS (SELECT l_orderkey, rank, count(*) AS c, min(i) AS first, any_value(candidates) AS candidates FROM n WHERE i <= 3 GROUP BY ALL),
  b AS (SELECT *, sum(c) OVER (PARTITION BY l_orderkey) AS counted FROM v QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, first) = 1)
  SELECT l_orderkey, rank AS suggested_rank, CASE WHEN candidates = 1 THEN 'high' WHEN c >= 2 AND c > counted / 2 THEN 'medium' ELSE 'low' END AS confidence, coalesce(candidates, 0) AS candidates
  FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN b USING (l_orderkey)""")
def osm_rank_rules(s, d):
    country = F.lit("zz")
    for flag, code in COUNTRIES:
        country = F.when(F.col("l_returnflag") == flag, code).otherwise(country)
    rank = nodes.rank_of(pick(F.col("l_partkey"), *PLACES), pick(F.col("l_suppkey"), *CATEGORIES), pick(F.col("l_partkey"), *KINDS), (F.col("l_quantity").cast("int") % 10), country)
    at = ((F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("int")
    return nodes.rank_vote(T(s, d, "lineitem").select("l_orderkey", at.alias("at"), rank.alias("rank")), "l_orderkey", "at", "rank")


@query("SELECT p_partkey, p_size, (3 * p_size - 2 + k)::INT AS nucleotide FROM part, range(3) AS u(k)")
def codon_positions(s, d):
    return sequences.codon_positions(T(s, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("p_size")), "p_size")


LINEAGES_SQL = "VALUES " + ", ".join(f"({i}, '{n}', {'NULL' if up is None else repr(up)})" for i, (n, _, _, up) in enumerate(models.LINEAGES))


@query(f"""WITH RECURSIVE l(i, n, up) AS ({LINEAGES_SQL}), p AS (SELECT p_partkey, n FROM part JOIN l ON i = p_size % 23),
  a AS (SELECT p_partkey, n AS ancestor, 0 AS steps FROM p UNION ALL SELECT a.p_partkey, l.up, steps + 1 FROM a JOIN l ON a.ancestor = l.n WHERE l.up IS NOT NULL)
  SELECT ancestor, count(*) AS parts, max(steps) AS farthest FROM a GROUP BY ancestor""")
def lineage_ancestors(s, d):
    """How many parts lie in each lineage, through all lineages above theirs."""
    own = T(s, d, "part").select(pick(F.col("p_size"), *(n for n, *_ in models.LINEAGES)).alias("lineage"))
    met = own.join(F.broadcast(models.ancestors(s)), "lineage")  # as many rows as the fixed lineages have steps
    return met.groupBy("ancestor").agg(F.count("*").alias("parts"), F.max("steps").alias("farthest"))


SIGNS = ("1", "present", " yes", "TRUE", "0", None, "absent", " True ")
YES = "('1', 'present', 'Present', 'TRUE', 'True')"


@query(f"""SELECT c_custkey, replace(trim(' ' || c_name || ' x'), ' ', '_') AS species, {" || ".join(f"CASE WHEN trim({pick_sql(f'(c_custkey // {8**i} + c_nationkey)', *SIGNS)}) IN {YES} THEN '1' ELSE '0' END" for i in range(3))} AS bits FROM customer""")
def geo_reformat(s, d):
    cells = [pick(F.floor(F.col("c_custkey") / 8**i) + F.col("c_nationkey"), *SIGNS).alias(c) for i, c in enumerate("abc")]
    rows = T(s, d, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name", F.lit(" x")).alias("name"), *cells)
    made = models.presence_rows(rows.withColumn("name", F.concat_ws("|", "name", "c_custkey")), "name", list("abc"))
    return made.select(F.substring_index("species", "|", -1).cast("long").alias("c_custkey"), F.substring_index("species", "|", 1).alias("species"), "bits")


@query("SELECT p_partkey, (SELECT sum(factorial(p_size % 13) // (factorial(k::INT) * factorial((p_size % 13 - k)::INT))) FROM range(0, least(p_size % 13, p_partkey % 7) + 1) AS t(k))::BIGINT AS states FROM part")
def state_count(s, d):
    return T(s, d, "part").select("p_partkey", models.state_counts(F.col("p_size").cast("int") % 13, (F.col("p_partkey") % 7).cast("int")).alias("states"))


NAMES = ("Part #:", "Qty ", "Project/grant", "Requested by:", "Shipping Notes")


@query(f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'catalog' WHEN 1 THEN 'quantity' WHEN 2 THEN 'account' WHEN 3 THEN 'requester' WHEN 4 THEN 'shipping_notes' ELSE replace(lower(p_type), ' ', '_') END AS canonical FROM part""")
def field_synonyms(s, d):
    field = F.when(F.col("p_partkey") % 6 == 5, F.concat(F.col("p_type"), F.lit(" :")))
    for i, n in enumerate(NAMES):
        field = field.when(F.col("p_partkey") % 6 == i, F.lit(n))
    return T(s, d, "part").select("p_partkey", requests.field_name(field).alias("canonical"))


@query("SELECT n_regionkey, replace(n_name, ' ', '_') AS tip FROM nation")
def newick_names(s, d):
    """Names read back from a tree of each region's nations; regions of an even number have branch lengths."""
    name = F.regexp_replace("n_name", " ", "_")
    with_length = F.when(F.col("n_regionkey") % 2 == 0, F.concat(name, F.lit(":0."), F.col("n_nationkey").cast("string"))).otherwise(name)
    trees = T(s, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list(with_length)), ","), F.lit(");")).alias("tree"))
    return trees.select("n_regionkey", F.explode(newick_tips(F.col("tree"))).alias("tip"))


# ---- sequences


HEXES = "0123456789abcdef"
KIND_LETTERS = ("ACGTacgtNUACG-?*", "RYryRYRYRY-?NRYR", "MKVLGHIPQRSTXW-?")


@query(f"""WITH q AS (SELECT p_partkey, translate(md5(p_name), '{HEXES}', {pick_sql("p_partkey", *KIND_LETTERS)}) AS s FROM part),
  n AS (SELECT p_partkey, s, regexp_replace(upper(s), '[-?NX*]', '', 'g') AS b FROM q),
  k AS (SELECT p_partkey, s, CASE WHEN length(b) > 0 AND length(regexp_replace(b, '[^ACGTU]', '', 'g')) / length(b) > 0.8 THEN 'nt' WHEN length(b) > 0 AND length(regexp_replace(b, '[^RY]', '', 'g')) / length(b) > 0.8 THEN 'RY' ELSE 'aa' END AS kind FROM n)
  SELECT p_partkey, kind, translate(upper(s), '?*', CASE WHEN kind = 'nt' THEN 'NN' ELSE 'XX' END) AS recoded FROM k""")
def sequence_kinds(s, d):
    seq = F.lit(None).cast("string")
    for i, letters in enumerate(KIND_LETTERS):
        seq = F.when(F.col("p_partkey") % len(KIND_LETTERS) == i, F.translate(F.md5("p_name"), HEXES, letters)).otherwise(seq)
    rows = T(s, d, "part").select("p_partkey", seq.alias("seq")).withColumn("kind", sequences.sequence_type(F.col("seq")))
    return rows.select("p_partkey", "kind", F.when(F.col("kind") == "nt", sequences.recoded(F.col("seq"), "nt")).otherwise(sequences.recoded(F.col("seq"), "aa")).alias("recoded"))


NUCLEOTIDES = "ACGTRYSWKMBDHVN-"
SETS = ", ".join(f"('{k}', '{v}')" for k, v in sequences.AMBIGUITY.items() if k != "U")


@query(f"""WITH m(l, v) AS (VALUES {SETS}), q AS (SELECT s_suppkey, translate(md5(s_name), '{HEXES}', '{NUCLEOTIDES}') AS a, translate(md5(s_address), '{HEXES}', '{NUCLEOTIDES}') AS b FROM (SELECT s_suppkey, s_name, s_name || s_nationkey AS s_address FROM supplier)),
  c AS (SELECT s_suppkey, i, substr(a, i::INT, 1) AS x, substr(b, i::INT, 1) AS y FROM q, range(1, 33) r(i)),
  u AS (SELECT s_suppkey, i, x, y, array_to_string(list_sort(list_distinct(list_concat(string_split(p.v, ''), string_split(q.v, '')))), '') AS v FROM c LEFT JOIN m p ON p.l = x LEFT JOIN m q ON q.l = y)
  SELECT s_suppkey, string_agg(coalesce(m.l, CASE WHEN x = y THEN x ELSE 'N' END), '' ORDER BY i) AS consensus FROM u LEFT JOIN m ON m.v = u.v AND x <> '-' AND y <> '-' GROUP BY s_suppkey""")
def consensus(s, d):
    other = F.concat("s_name", F.col("s_nationkey").cast("string"))
    a, b = (F.translate(F.md5(c), HEXES, NUCLEOTIDES) for c in (F.col("s_name"), other))
    return T(s, d, "supplier").select("s_suppkey", sequences.consensus(a, b).alias("consensus"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 6 ELSE p_size + p_size % 2 END::INT AS w FROM part")
def even_windows(s, d):
    return T(s, d, "part").select("p_partkey", sequences.even_width(F.when(F.col("p_partkey") % 5 > 0, F.col("p_size"))).alias("w"))


RESIDUES = sequences.AMINO_ACIDS


@query(f"""WITH q AS (SELECT s_nationkey AS k, s_suppkey AS t, translate(md5(s_name), '0123456789b', 'GHIKLMNPQRS') AS seq FROM supplier),
  p AS (SELECT a.k, a.t AS a, b.t AS b, upper(a.seq) AS x, upper(b.seq) AS y FROM q a JOIN q b ON a.k = b.k AND a.t < b.t),
  c AS (SELECT k, a, b, instr('{RESIDUES}', substr(x, i::INT, 1)) AS f, instr('{RESIDUES}', substr(y, i::INT, 1)) AS g FROM p, range(1, 33) r(i))
  SELECT k AS s_nationkey, a, b, round(sum(CASE WHEN f = 0 OR g = 0 THEN 0 WHEN f = g THEN 4 + 0.25 * f ELSE -1.5 END)::DOUBLE, 6) AS score FROM c GROUP BY k, a, b""")
def matrix_scores(s, d):
    """Pairs scored by a matrix that is read from its file."""
    rows = "".join(x + "".join(f" {4 + 0.25 * (i + 1) if x == y else -1.5}" for y in RESIDUES) + "\n" for i, x in enumerate(RESIDUES))
    matrix = read_matrix(s, write_text(s, f"{work_folder(s, 'matrix')}/m.txt", f"# a matrix\n  {' '.join(RESIDUES)}\n{rows}"))
    seqs = T(s, d, "supplier").select("s_nationkey", "s_suppkey", F.translate(F.md5("s_name"), "0123456789b", "GHIKLMNPQRS").alias("seq"))
    table = sequences.score_table(RESIDUES + "-", "aa", matrix)
    made = pairwise.matrix_sums(seqs, ["s_nationkey"], "s_suppkey", "seq", RESIDUES, table)
    return made.withColumn("score", F.round(F.round("score", 9), 6))


@query("""WITH p AS (SELECT p_brand, pos, count(DISTINCT ch) AS n FROM (SELECT p_brand, p_partkey, i::INT - 1 AS pos, upper(substr(md5(p_name), i::INT, 1)) AS ch FROM part, range(1, 33) AS r(i)) GROUP BY ALL),
  h AS (SELECT p_brand, pos, pos - row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS g FROM p WHERE n >= 3),
  r AS (SELECT p_brand, min(pos)::INT AS start, max(pos)::INT AS "end", count(*) AS length FROM h GROUP BY p_brand, g)
  SELECT p_brand, start, "end", length, start + 2 AS skip_start, "end" - 2 AS skip_end FROM r WHERE length >= 4 AND "end" - 2 >= start + 2""")
def skipped_sections(s, d):
    """Runs of columns with three letters and more, less the two columns at each end that windows of three still see."""
    cells = sequences.columns_of(T(s, d, "part").select("p_brand", "p_partkey", F.md5("p_name").alias("seq")), ["p_brand"], "p_partkey", "seq")
    patterns = sequences.site_patterns(cells, ["p_brand"])
    return sequences.skipped_sections(sequences.runs(patterns, ["p_brand"], "pos", F.col("n_states") >= 3), w=3)


# ---- models, species, scores


@query("""WITH a AS (SELECT DISTINCT p_brand || p_size AS name FROM part WHERE p_partkey % 3 < 2), b AS (SELECT DISTINCT p_brand || p_size AS name FROM part WHERE p_partkey % 3 > 0)
  SELECT name, 'tree' AS missing_in FROM a ANTI JOIN b USING (name) UNION ALL SELECT name, 'matrix' FROM b ANTI JOIN a USING (name)""")
def tree_differences(s, d):
    """Names of the matrix that the tree lacks, and the other way round."""
    rows = T(s, d, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("name"), (F.col("p_partkey") % 3).alias("k"))
    return models.name_differences(rows.where("k < 2"), rows.where("k > 0"), "name")


@query("""WITH a AS (SELECT DISTINCT p_brand || p_size AS name, p_brand FROM part WHERE p_partkey % 3 < 2), b AS (SELECT DISTINCT p_brand || p_size AS name FROM part WHERE p_partkey % 3 > 0),
  u AS (SELECT name FROM a UNION SELECT name FROM b)
  SELECT count(*) FILTER (name IN (SELECT name FROM a)) AS in_matrix, count(*) FILTER (name IN (SELECT name FROM b)) AS in_tree, count(*) FILTER (name IN (SELECT name FROM a) AND name IN (SELECT name FROM b)) AS in_both FROM u""")
def reference_counts(s, d):
    rows = T(s, d, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("name"), (F.col("p_partkey") % 3).alias("k"))
    missing = models.name_differences(rows.where("k < 2"), rows.where("k > 0"), "name").groupBy().agg(F.count_if(F.col("missing_in") == "tree").alias("a"), F.count_if(F.col("missing_in") == "matrix").alias("b"))
    every = rows.groupBy().agg(F.countDistinct("name").alias("n"))
    return every.join(missing).select((F.col("n") - F.col("b")).alias("in_matrix"), (F.col("n") - F.col("a")).alias("in_tree"), (F.col("n") - F.col("a") - F.col("b")).alias("in_both"))  # one row each


MODELS = ("DEC", "DEC+J", "DIVALIKE", "DIVALIKE+J", "BAYAREALIKE", "BAYAREALIKE+J")


@query(f"""SELECT p_partkey, CASE p_partkey % 6 // 2 WHEN 0 THEN 'DEC' WHEN 1 THEN 'DIVALIKE' ELSE 'BAYAREALIKE' END AS family, p_partkey % 2 = 1 AS founder, p_partkey % 6 < 2 AS subset, p_partkey % 6 < 4 AS vicariance, CASE WHEN p_partkey % 6 // 2 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS y FROM part""")
def model_switches(s, d):
    o = models.options_of(pick(F.col("p_partkey"), *MODELS))
    return T(s, d, "part").select("p_partkey", o.alias("o")).select("p_partkey", "o.family", "o.founder", F.col("o.s").alias("subset"), F.col("o.v").alias("vicariance"), "o.y")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN true WHEN o_orderkey % 5 IN (1, 2) THEN false ELSE true END AS same, o_orderkey % 5 = 0 OR o_orderkey % 5 = 3 AS same_exactly,
    CASE WHEN o_orderkey % 4 < 3 THEN 1 ELSE 0 END::INT AS tp, CASE WHEN o_orderkey % 4 < 3 THEN 0 ELSE 1 END::INT AS fp FROM orders""")
def text_comparison(s, d):
    """Texts compared with and without regard to blanks and case, and predictions where the truth is empty."""
    n, p = F.col("o_orderkey"), F.col("o_orderpriority")
    other = F.when(n % 5 == 0, p).when(n % 5 == 1, F.concat(p, F.lit("x"))).when(n % 5 == 4, F.concat(F.lit("  "), F.upper(p), F.lit(" ")))
    mine = F.when(n % 5 != 3, p)
    empty = F.when(n % 4 == 1, "").when(n % 4 == 2, "[]").when(n % 4 == 3, p)
    c = scoring.empty_counts(empty)
    return T(s, d, "orders").select("o_orderkey", scoring.same_text(mine, other).alias("same"), scoring.same_text(mine, other, fuzzy=False).alias("same_exactly"), c["tp"].alias("tp"), c["fp"].alias("fp"))


# ---- pages and files


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'skip' WHEN p_size > 32 THEN 'error' ELSE 'ready' END AS gate FROM part""")
def size_gates(s, d):
    path = F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).when(F.col("p_partkey") % 8 > 0, F.lit("  "))
    return T(s, d, "part").select("p_partkey", extraction.size_gate(path, F.col("p_size").cast("long") * (1 << 20)).alias("gate"))


@query(r"SELECT doc_id, count(*) FILTER (regexp_matches(line, '(?i)^[\s>*_-]*(figs?|figure|plate|pl)\.?\s*[\dIVXLCM]+')) AS captions, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(replace(text, ' ', chr(10)), chr(10))) AS line FROM (SELECT doc_id, replace(replace(text, ' the ', ' the'||' '), 'a', 'Fig. 1') AS text FROM documents)) GROUP BY doc_id")
def caption_lines(s, d):
    """Lines (here: words) of texts that begin like a caption, once every a has become one."""
    body = F.regexp_replace(F.regexp_replace("text", "a", "Fig. 1"), " ", "\n")
    lines = T(s, d, "documents").select("doc_id", F.explode(F.split(body, "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(text.is_caption(F.col("line"))).alias("captions"), F.count("*").alias("lines"))


@query("""WITH c AS (SELECT *, p_size % 3 AS n, p_partkey % 4 AS f FROM part), u AS (SELECT *, least(n, f) AS used FROM c)
  SELECT p_partkey, 'About ' || p_name || CASE WHEN n > 0 THEN chr(10) || CASE WHEN used > 0 THEN 'fig0' || chr(10) || chr(10) ELSE '' END || 'Figure 1. ' || p_type ELSE '' END
    || CASE WHEN n > 1 THEN chr(10) || CASE WHEN used > 1 THEN 'fig1' || chr(10) || chr(10) ELSE '' END || '> Plate IV ' || p_brand ELSE '' END
    || array_to_string(list_transform(range(used, f), lambda i: chr(10) || chr(10) || 'fig' || i), '') AS page FROM u""")
def placed_figures(s, d):
    """A page's figures above its captions; those left over at the end."""
    n = F.col("p_size") % 3
    body = F.concat_ws("\n", F.concat(F.lit("About "), "p_name"), F.when(n > 0, F.concat(F.lit("Figure 1. "), "p_type")), F.when(n > 1, F.concat(F.lit("> Plate IV "), "p_brand")))
    figures = F.slice(F.array(*(F.lit(f"fig{i}") for i in range(3))), F.lit(1), (F.col("p_partkey") % 4).cast("int"))
    return T(s, d, "part").select("p_partkey", pages.with_figures(body, figures).alias("page"))


@query("""SELECT l_orderkey, l_linenumber, greatest(0, least(l_partkey % 900 + 100, round(l_quantity * 20 * 1.5)))::INT AS x, greatest(0, least(600, round((792 - l_quantity * 20) * 1.5)))::INT AS y FROM lineitem""")
def point_boxes(s, d):
    at = F.col("l_quantity") * 20
    return T(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", text.point_pixels(at, F.lit(1.5), F.col("l_partkey") % 900 + 100).alias("x"), text.point_pixels(at, F.lit(1.5), F.lit(600), flip_from=F.lit(792)).alias("y")
    )
