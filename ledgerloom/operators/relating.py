"""Relations between entities: pairs scored by their names and by overlaps of their attribute sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linking
from .components import components


def overlap(a: Column, b: Column, same: int, other: int) -> Column:
    """``same`` if two sets share a value, ``other`` if both have values and share none, else 0."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both & F.arrays_overlap(a, b), same).when(both, other).otherwise(0)


def same_name_pairs(entities: DataFrame, most: int) -> DataFrame:
    """(a, b) with a < b of entities of one name, whose number has no limit.

    Up to ``most`` of a name make all pairs. Of a name that more share, those with equal attributes
    are linked to the smallest id of them and only these smallest ids make pairs: the score and
    relation of any other two are those of the ids they are linked to.
    """
    sets = ["regions", "owners", "identifiers", "phases"]
    named = entities.filter("name <> ''").select("id", "name", *(F.array_sort(c).alias(c) for c in sets))
    sizes = linking.block_sizes(named.select(F.col("name").alias("key")))
    small = named.join(sizes.filter(F.col("size").between(2, most)).select(F.col("key").alias("name")), "name", "left_semi")
    hot = named.join(sizes.filter(F.col("size") > most).select(F.col("key").alias("name")), "name", "left_semi")
    firsts = hot.groupBy("name", *sets).agg(F.min("id").alias("a"))
    links = hot.join(firsts, ["name", *sets]).filter("id > a").select("a", F.col("id").alias("b"))
    ends = small.select("name", "id").unionByName(firsts.select("name", F.col("a").alias("id")))
    x, y = ends.alias("x"), ends.alias("y")
    return links.unionByName(x.join(y, (F.col("x.name") == F.col("y.name")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))


def related(entities: DataFrame, keys: DataFrame, least: int = 60) -> DataFrame:
    """(a, b, score, relation) of entities that share a name or a block and score at least ``least`` of 100.

    Blocks of more than 20 make no pairs, names have no limit (``same_name_pairs``).
    entities: (id, name, regions, owners, identifiers, phases), the last four arrays; keys: (key, id).
    """
    pairs = linking.blocked_pairs(keys, most=20).unionByName(same_name_pairs(entities, most=20)).distinct()
    pairs = linking.with_both(pairs, entities, "id", ["name", "regions", "owners", "identifiers", "phases"])
    contained = F.contains("a_name", F.col("b_name")) | F.contains("b_name", F.col("a_name"))
    name = F.when(F.col("a_name") == F.col("b_name"), 55).when(contained, 40).otherwise(30)
    score = name + overlap(F.col("a_identifiers"), F.col("b_identifiers"), 30, 0) + overlap(F.col("a_regions"), F.col("b_regions"), 10, -25) + overlap(F.col("a_owners"), F.col("b_owners"), 10, -20) + overlap(F.col("a_phases"), F.col("b_phases"), 5, -10)
    score = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")
    phases = (F.size("a_phases") > 0) & (F.size("b_phases") > 0) & ~F.arrays_overlap("a_phases", "b_phases")
    relation = F.when(phases, "OTHER_PHASE").when(contained & (F.col("a_name") != F.col("b_name")), "PART").otherwise("SAME")
    return pairs.select("a", "b", score.alias("score"), relation.alias("relation")).filter(F.col("score") >= least)


def by_identifiers(links: DataFrame) -> DataFrame:
    """(id, entity): records that share an identifier, directly or through others, are one entity, named by the smallest id.

    links: (id, identifier). Records whose identifiers nobody else has are entities of their own.
    """
    named = links.filter("identifier <> ''").select("id", "identifier").distinct()
    first = named.groupBy("identifier").agg(F.min("id").alias("a"))
    edges = named.join(first, "identifier").filter("id > a").select("a", F.col("id").alias("b"))
    roots = components(edges)
    return links.select("id").distinct().join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("entity"))
