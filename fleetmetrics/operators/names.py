"""Resolve loosely typed names to instance ids, one account and region at a time.

A name is tried as: 1 an exact instance id, 2 an exact cluster id (its
members), 3 part of cluster ids (their members), 4 part of instance ids. The
first tier with a result wins within an account and region. Case and surrounding
blanks do not matter.

All four tiers are one substring search, because an exact id also contains its
name. The search is an equi-join on the whole name, not a nested loop over all
pairs: an identifier is cut into its substrings of just those lengths that occur
among the names, so only true matches come out of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PLACE = ["account_id", "region"]
KEY = ["name", *PLACE]


def normalize(name: Column) -> Column:
    """A name without surrounding blanks, in lower case."""
    return F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def substring_pairs(names: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Each identifier row next to every name it contains.

    ``names`` holds distinct, non-empty normalized names in column ``name``;
    identifiers come in column ``identifier`` (compared in lower case) with any
    others. Rows grow with the inventory: an identifier of n characters gives at
    most n substrings for each length in use. The lengths in use are broadcast;
    k of them need at least k * k / 2 characters of names, so they stay few.
    """
    lengths = names.select(F.char_length("name").alias("_size")).distinct()
    text = F.lower("identifier")
    last = F.char_length(text) - F.col("_size") + 1
    cuts = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.col("_size")))
    sized = (
        identifiers.where(F.col("identifier") != "")
        .withColumn("_size", F.explode(F.sequence(F.lit(1), F.char_length(text))))
        .join(F.broadcast(lengths), "_size")
    )
    return (
        sized.withColumn("name", F.explode(F.array_distinct(cuts)))
        .join(names.select("name"), "name")
        .select("name", *identifiers.columns)
    )


def name_hits(names: DataFrame, members: DataFrame, instances: DataFrame) -> DataFrame:
    """(name, account_id, region, tier, place, identifier) for every id that contains a name.

    Clusters without members never answer, so they are taken from ``members``.
    ``place`` is the listing order among equally spelled ids, 0 in the
    substring tiers, where every hit counts.
    """
    wanted = names.select(normalize(F.col("name")).alias("name")).where(F.col("name") != "").distinct()
    clusters = (
        members.where(F.col("identifier").isNotNull() & F.col("cluster_identifier").isNotNull())
        .groupBy(*PLACE, F.col("cluster_identifier").alias("identifier"))
        .agg(F.min("cluster_ordinal").alias("ordinal"))
        .withColumn("is_cluster", F.lit(True))
    )
    known = (
        instances.where(F.col("identifier").isNotNull())
        .groupBy(*PLACE, "identifier")
        .agg(F.min("ordinal").alias("ordinal"))
        .withColumn("is_cluster", F.lit(False))
    )
    exact = F.lower("identifier") == F.col("name")
    cluster = F.col("is_cluster")
    tier = F.when(exact & ~cluster, 1).when(exact, 2).when(cluster, 3).otherwise(4)
    return (
        substring_pairs(wanted, clusters.unionByName(known))
        .withColumn("tier", tier)
        .select(
            *KEY,
            "tier",
            F.when(F.col("tier") <= 2, F.coalesce("ordinal", F.lit(0))).otherwise(0).cast("long").alias("place"),
            "identifier",
        )
    )


def best_tiers(hits: DataFrame) -> DataFrame:
    """The tier that answers each (name, account, region), and the first place in it."""
    return (
        hits.groupBy(*KEY)
        .agg(F.min(F.struct("tier", "place")).alias("best"))
        .select(*KEY, "best.tier", "best.place")
    )


def expand_hits(hits: DataFrame, chosen: DataFrame, members: DataFrame) -> DataFrame:
    """Ids of the chosen hits: clusters become their members, instances stay.

    Instances look for members under a key no cluster has; that spreads them
    over tasks, where a NULL key would gather them in one.
    """
    cluster_hit = F.col("tier").isin(2, 3)
    listed = members.where(F.col("identifier").isNotNull()).select(
        *PLACE,
        F.col("cluster_identifier").alias("lookup"),
        F.col("identifier").alias("member"),
        F.col("member_pos").cast("long").alias("member_pos"),
    )
    return (
        hits.join(chosen, [*KEY, "tier", "place"])
        .withColumn(
            "lookup",
            F.when(cluster_hit, F.col("identifier")).otherwise(F.concat(F.lit("\0"), "identifier")),
        )
        .join(listed, [*PLACE, "lookup"], "left")
        .select(
            *KEY,
            "tier",
            F.coalesce("member", "identifier").alias("resource_id"),
            F.when(F.col("tier") == 2, F.col("member_pos")).alias("position"),
        )
        .distinct()
    )


def resolve_names(names: DataFrame, members: DataFrame, instances: DataFrame) -> DataFrame:
    """(name, account_id, region, tier, resource_id, position) for all distinct names.

    ``position`` orders the members of an exact cluster; the other tiers are
    ordered by id. Names without a match give no row. Rows stay long, so a name
    that matches a whole fleet is never one array.
    """
    hits = name_hits(names, members, instances)
    return expand_hits(hits, best_tiers(hits), members)
