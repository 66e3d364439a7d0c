"""Projects and entities by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import candidate_rank, project_name, project_terms
from ..sources.folders import parts_of, shared_folder
from .pending import first_n

#: Length of the grams that lead from a name asked for to the names that may match, and how many of them, the rarest, are met.
GRAM, MOST_GRAMS = 3, 3
#: Bytes of stored names whose grams one task cuts.
NAME_BYTES = 1 << 20


def _grams(text: Column, size: int) -> Column:
    """All runs of `size` characters of a text."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substr(text, i, F.lit(size)))


def name_grams(labels: Column, sizes: list[int]) -> Column:
    """Distinct grams of the labels without their separators."""
    none = F.array().cast("array<string>")
    of = lambda label: F.concat(*[F.when(F.length(label) >= n, _grams(label, n)).otherwise(none) for n in sizes])
    return F.array_distinct(F.flatten(F.transform(labels, lambda label: of(F.translate(F.regexp_replace(label, " +", ""), "-_", "")))))


def asked_grams(asked: Column) -> Column:
    """Distinct grams of the terms of a name asked for; a shorter term is one."""
    return F.array_distinct(F.flatten(F.transform(project_terms(asked), lambda t: F.when(F.length(t) >= GRAM, _grams(t, GRAM)).otherwise(F.array(t)))))


def rank_projects(queries: DataFrame, projects: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, rank, id, name of the best projects (id, name, aliases) for each name asked for.

    Every way to match needs each term asked for to be within a name or alias whose
    separators are left out, so all grams of the terms are there, too. The rarest of
    them lead to the projects that hold them all, by an equi-join; only these are
    matched in full. A name asked for of separators alone has no grams, and meets
    the projects that a term match takes: all.
    """
    known = projects.where(F.length(F.trim("name")) > 0).select("id", "name", project_name(F.col("name")).alias("norm"), F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: project_name(a)), lambda a: a != "").alias("alias_norms"))
    asked = queries.select("query_id", project_name(F.col("name")).alias("asked")).where("asked <> ''").select("*", asked_grams(F.col("asked")).alias("grams"))
    wanted = asked.select("query_id", "asked", F.explode("grams").alias("gram"))
    # names are few bytes and many grams: files that one task would read are dealt to many before the grams are cut
    known = known.repartition(parts_of(projects, size=NAME_BYTES))
    sizes = {r[0] for r in asked.select(F.explode_outer("grams").alias("g")).select(F.length("g")).distinct().collect()}  # GRAM numbers, and null, at most
    labels = F.concat(F.array("norm"), "alias_norms")
    listed = known.select("*", F.explode(name_grams(labels, sorted(sizes - {None}))).alias("gram")) if sizes - {None} else known.select("*", F.lit(None).cast("string").alias("gram")).limit(0)
    path = f"{shared_folder(queries.sparkSession, 'names')}/hits"
    listed.join(wanted.select(F.col("gram").alias("g")).distinct(), F.col("gram") == F.col("g"), "left_semi").write.parquet(path)
    listed = queries.sparkSession.read.schema(listed.schema).parquet(path)
    counts = listed.groupBy("gram").agg(F.count("*").alias("n"))
    rare = first_n(wanted.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))), ["query_id", "asked"], ["n", "gram"], MOST_GRAMS)
    met = listed.join(rare.select("query_id", "asked", "gram"), "gram").groupBy("query_id", "asked", "id", "name", "norm", "alias_norms").agg(F.count("*").alias("held"))
    needed = asked.select(F.col("query_id").alias("q"), F.col("asked").alias("a"), F.least(F.size("grams"), F.lit(MOST_GRAMS)).alias("needed"))
    met = met.join(needed.distinct(), F.col("query_id").eqNullSafe(F.col("q")) & (F.col("asked") == F.col("a")) & (F.col("held") % F.col("needed") == 0) & (F.col("held") >= F.col("needed")))
    columns = ["query_id", "asked", "id", "name", "norm", "alias_norms"]
    met = met.withColumn("row", F.explode(F.array_repeat(F.lit(1), (F.col("held") / F.col("needed")).cast("int"))))  # repeated rows stay
    if None in sizes:
        bare = asked.where("size(grams) = 0").select("query_id", "asked")
        every = bare.withColumn("all", F.lit(1)).join(known.withColumn("all", F.lit(1)), "all").select(*columns)
        met = met.select(*columns).unionByName(every)
    ranked = met.withColumn("match", candidate_rank(F.col("asked"), F.col("norm"), F.col("alias_norms"))).where("match IS NOT NULL")
    return first_n(ranked.select("query_id", "match", "norm", "id", "name"), ["query_id"], ["match", "norm", "id"], limit).select("query_id", "match", "id", "name", "rank")


def listed_projects(projects: DataFrame, scope: str | None = None) -> DataFrame:
    own = projects if scope is None else projects.where(F.col("scope") == scope)
    return own.orderBy("normalized_name", "id")


def resolve_single(ranked: DataFrame, most: int = 3) -> DataFrame:
    """Ranked projects of queries with at most `most` of them; more raise."""
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    return ranked.join(counts.where(F.assert_true(F.col("n") <= most, "more projects than a choice can offer").isNull()).select("query_id"), "query_id", "left_semi")


def with_other_option(ranked: DataFrame) -> DataFrame:
    """Ranked projects and, for queries that have any, a closing row for other options."""
    other = ranked.select("query_id").distinct().select("query_id", F.lit(None).cast("int").alias("match"), F.lit(None).cast(ranked.schema["id"].dataType).alias("id"), F.lit("Other options").alias("name"), F.lit(None).cast("int").alias("rank"))
    return ranked.unionByName(other)


def known_entities(entities: DataFrame) -> DataFrame:
    return entities.select("scope", "id", "name", "aliases").orderBy("scope", "name", "id")
