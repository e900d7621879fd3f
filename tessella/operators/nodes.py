"""Planning batches of new nodes, ranks from map features, ids coming back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.numbering import in_sequence

# Ranks by place type, by administrative level and country, and the ranks that may be uploaded.
PLACE_RANKS = {"city": "City", "town": "Town", "village": "Village", "hamlet": "Village", "municipality": "Municipality", "county": "County", "state": "State", "province": "Province", "country": "Country", "continent": "Continent"}
LEVEL_RANKS = {
    "us": {4: "State", 6: "County", 7: "City", 8: "City"},
    "ca": {4: "Province", 6: "County", 8: "City"},
    "br": {4: "State", 6: "Municipality", 8: "City"},
    "gb": {4: "Country", 6: "County", 8: "City"},
    "uk": {4: "Country", 6: "County", 8: "City"},
    "fr": {4: "Region", 6: "Department", 7: "Arrondissement", 8: "City"},
    "": {3: "Region", 4: "State", 5: "Region", 6: "County", 7: "Municipality", 8: "City"},
}
ALLOWED_RANKS = (
    "Arrondissement", "Autonomous Community", "Autonomous Region", "Borough", "Canton", "Census-designated Place (CDP)", "City", "Continent",
    "Country", "County", "Crown Dependency", "Department", "District", "Federal District", "Federal Subject", "Federal Territory",
    "Kingdom", "LMA", "Municipality", "Nation", "National District", "Oblast", "Oblast/Republic", "Overseas Territory",
    "Parish", "pd2", "pd3", "pd4", "Planet", "Plot/Transect", "Precise Locality", "Prefecture",
    "Province", "Province (wilaya)", "Regency", "Region", "Regional County Municipality", "Sample Area", "Satellite", "Semi-independent Entity",
    "Senatorial District", "Shire", "State", "Subdivision", "Subprefecture", "Territory", "Town", "Village",
)


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def rank_of(place: Column, category: Column, kind: Column, level: Column, country: Column) -> Column:
    """A feature's rank: by place, then as a protected area, then by administrative level; null if nothing fits."""
    code = F.lower(F.coalesce(country, F.lit("")))
    by_level = F.when(level == 2, "Country")
    for cc, ranks in LEVEL_RANKS.items():
        by_level = by_level.when(code == cc, lookup(ranks, level)) if cc else by_level.otherwise(lookup(ranks, level))
    park = ((category == "boundary") & kind.isin("national_park", "protected_area")) | ((category == "leisure") & (kind == "park"))
    administrative = (category == "boundary") & (kind == "administrative") & (F.coalesce(level, F.lit(0)) != 0)
    return F.coalesce(lookup(PLACE_RANKS, F.coalesce(place, F.lit(""))), F.when(park, "LMA"), F.when(administrative, by_level))


def rank_vote(df: DataFrame, query: str, order: str, rank: str) -> DataFrame:
    """Per query the rank most frequent among its first three ranked candidates (ties: the one met first), with confidence."""
    w = Window.partitionBy(query).orderBy(order)
    ranked = df.where(F.col(rank).isNotNull()).withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy(query)))
    votes = ranked.where("_n <= 3").groupBy(query, rank).agg(F.count("*").alias("n"), F.min("_n").alias("first"), F.max("_all").alias("all"))
    best = votes.groupBy(query).agg(F.max_by(F.struct(rank, "n"), F.struct(F.col("n"), -F.col("first"))).alias("b"), F.sum("n").alias("counted"), F.max("all").alias("candidates"))
    sure = F.when(F.col("candidates") == 1, "high").when((F.col("b.n") >= 2) & (F.col("b.n") > F.col("counted") / 2), "medium").otherwise("low")
    made = best.select(query, F.col(f"b.{rank}").alias("suggested_rank"), sure.alias("confidence"), F.col("candidates"))
    return df.select(query).distinct().join(made, query, "left").select(query, "suggested_rank", F.coalesce("confidence", F.lit("low")).alias("confidence"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def by_distance(df: DataFrame, query: str, distance: str, order: str) -> DataFrame:
    """Candidates of a query by distance; those without one come last."""
    w = Window.partitionBy(query).orderBy(F.coalesce(F.col(distance), F.lit(999.0)), order)
    return df.withColumn("position", F.row_number().over(w))


def pending(depth: Column, row: Column) -> Column:
    return F.format_string("__PENDING_B%d_R%d__", depth.cast("int"), row.cast("int"))


def plan_batches(chains: DataFrame, chain_id: str, parent: str, nodes: str, classification: str = "Terrestrial") -> DataFrame:
    """New nodes of all chains, one row each: (id, depth, rank, name, coords, elevation, parent_ref).

    nodes is an array of (rank, name, status, irn, coords, elevation), general first. A node that
    exists becomes the parent of the next. Nodes that agree in everything, their parent included,
    are made once; a node is told by the path of new nodes above it and the known id above those, so
    no chain waits for another. Ids follow the order in which chains first name a node.
    """
    known = F.lit("\u0001")

    def step(a: Column, x: Column) -> Column:
        name = F.coalesce(x["name"], F.lit(""))
        key = F.concat_ws("\u0002", a["path"], F.concat_ws("\u0003", x["rank"], name, F.to_json(F.struct(x["coords"], x["elevation"]))))
        made = F.struct((a["depth"] + 1).alias("depth"), key.alias("key"), a["path"].alias("above"), x["rank"].alias("rank"), name.alias("name"), x["coords"].alias("coords"), x["elevation"].alias("elevation"))
        exists = x["status"] == "exists"
        return F.struct(
            F.when(exists, F.concat(known, F.coalesce(x["irn"].cast("string"), F.lit("")))).otherwise(key).alias("path"),
            F.when(exists, a["depth"]).otherwise(a["depth"] + 1).alias("depth"),
            F.when(exists, a["out"]).otherwise(F.concat(a["out"], F.array(made))).alias("out"),
        )

    item = chains.schema[nodes].dataType.elementType
    shape = f"array<struct<depth:int,key:string,above:string,rank:string,name:string,coords:{item['coords'].dataType.simpleString()},elevation:{item['elevation'].dataType.simpleString()}>>"
    start = F.struct(F.concat(known, F.coalesce(F.col(parent).cast("string"), F.lit(""))).alias("path"), F.lit(0).alias("depth"), F.array().cast(shape).alias("out"))
    walked = F.aggregate(F.col(nodes), start, lambda a, x: step(a, x).cast(f"struct<path:string,depth:int,out:{shape}>"))
    rows = chains.select(chain_id, F.posexplode(walked["out"]).alias("pos", "n")).select(chain_id, "pos", "n.*")
    # A path may name a node more than once over the chains: the first chain and place decide its number.
    new = rows.groupBy("depth", "key", "above", "rank", "name", "coords", "elevation").agg(F.min(F.struct(chain_id, "pos")).alias("at"))
    new = in_sequence(new, ["at"], "id").withColumn("id", F.col("id").cast("int"))  # one sequence, as the upload needs it
    parents = new.select(F.col("key").alias("above"), F.col("depth").alias("d"), F.col("id").alias("parent_id"))
    made = new.join(parents, (new["above"] == parents["above"]) & (parents["d"] == new["depth"] - 1), "left")
    given = ~F.contains(new["above"], F.lit("\u0002"))  # nothing new stands above
    ref = F.when(given, F.substring(new["above"], 2, 1 << 30)).otherwise(pending(new["depth"] - 1, F.col("parent_id")))
    return made.select("id", new["depth"], F.lit(classification).alias("classification"), "rank", "name", "coords", "elevation", ref.alias("parent_ref"))


def pending_count(df: DataFrame, ref: str = "parent_ref", depth: str = "depth") -> DataFrame:
    return df.groupBy(depth).agg(F.count("*").alias("n_rows"), F.count_if(F.startswith(F.coalesce(ref, F.lit("")), F.lit("__PENDING_"))).alias("pending"))


def resolve(batches: DataFrame, returned: DataFrame) -> DataFrame:
    """parent_ref with placeholders replaced by the ids that came back: returned has (depth, id, irn)."""
    known = returned.select(pending(F.col("depth"), F.col("id")).alias("parent_ref"), F.col("irn").cast("string").alias("_irn"))
    return batches.join(known, "parent_ref", "left").withColumn("parent_ref", F.coalesce("_irn", "parent_ref")).drop("_irn")


def back_fill(rows: DataFrame, ids: DataFrame, row: str, irn: str, after: str | None) -> DataFrame:
    """rows with an id column from ids, behind a column, or last if that is missing."""
    made = rows.drop(irn).join(ids.select(row, irn), row, "left")
    order = [c for c in rows.columns if c != irn]
    at = order.index(after) + 1 if after in order else len(order)
    return made.select(*order[:at], irn, *order[at:])


def rejected_ranks(df: DataFrame, rank: str) -> DataFrame:
    """Rows whose rank the upload would reject."""
    return df.where(~F.coalesce(F.col(rank), F.lit("")).isin(*ALLOWED_RANKS))


def filled_columns(df: DataFrame) -> list[str]:
    """Columns with at least one value, found in one pass."""
    row = df.agg(*(F.max(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").alias(c) for c in df.columns)).first()
    return [c for c in df.columns if row[c]]
