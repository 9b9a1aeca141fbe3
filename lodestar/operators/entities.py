"""Entities: keys of names, candidates for aliases, and merges that never join two guarded identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scalars import word_set
from lodestar.operators.components import connect, thinned
from lodestar.operators.similarity import similar_names
from lodestar.session import materialize

#: Least Jaccard similarity of two names' words; rounds in which identities spread along links.
LEAST, ROUNDS = 0.8, 100
#: Entities without an identity that are sent to all tasks at most.
FEW = 100_000


def entity_key(name: Column) -> Column:
    """The name trimmed, white space runs as one space, in lower case, typographic quotes as '. Text is taken as composed."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), r"[\p{Pi}\p{Pf}\x{02BC}]", "'")


def evolution_chain(names: Column) -> Column:
    """The names an entity has had, in order, each key once in its first spelling; empty names are none."""
    keyed = F.filter(F.transform(names, lambda n: F.struct(entity_key(n).alias("key"), n.alias("name"))), lambda x: x["key"] != "")
    first = F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, F.lit(1), i), lambda e: e["key"] == x["key"]))
    return F.transform(first, lambda x: x["name"])


def alias_candidates(entities: DataFrame, least: float = LEAST, scope: tuple[str, ...] = ("active",), guarded: bool = False) -> DataFrame:
    """(category, a, b, similarity) of entities (id, category, name, aliases, status) whose names' words have at least this Jaccard similarity.

    Both are of one category and in scope, and have no name or alias in common yet. A pair shares some of the first few words
    of its names, rarest first, so that common words pair nothing; it is tested where it is made and not joined again. A
    null category is a category of its own. Keys of names are compared as 64-bit hashes. guarded: with the column identity
    of both as identity_a and identity_b.
    """
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = F.transform(F.array_distinct(F.transform(names, entity_key)), lambda k: F.when(k.isNotNull(), F.xxhash64(k)))
    known = entities.where(F.col("status").isin(*scope)).select("id", F.coalesce("category", F.lit("")).alias("bucket"), word_set(F.col("name")).alias("words"), keys.alias("keys"), *(["identity"] if guarded else []))
    pairs = similar_names(known, least, ["keys", "identity"] if guarded else ["keys"]).where(~F.arrays_overlap("x_keys", "y_keys"))
    more = [F.col("x_identity").alias("identity_a"), F.col("y_identity").alias("identity_b")] if guarded else []
    return pairs.select(F.col("bucket").alias("category"), "a", "b", F.round("similarity", 4).alias("similarity"), *more)


def merge_groups(links: DataFrame, identities: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(groups, conflicts) of links (a, b, similarity) between entities with guarded identities (id, identity).

    groups: (id, group, identity, divided) of every linked entity. A component with at most one identity is one group. In
    one with more, entities take over an identity along links, those next to it first: in each round an entity without one
    follows its strongest link (ties: the least neighbour) to one that has it. So no group holds two identities; group is
    the least id of a component and identity, divided tells that its component had several. conflicts: (a, b, similarity,
    identity_a, identity_b) of the links that the guard cut. An id with two identities is an error.
    """
    guarded = _guarded(identities)
    pairs = links.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))
    held = lambda s: guarded.select(F.col("id").alias(s), F.col("identity").alias(f"identity_{s}"))
    pairs = materialize(pairs.join(held("a"), "a", "left").join(held("b"), "b", "left"), "merge-links")
    state = _settled(pairs, guarded, rounds)
    side = lambda s: state.select(F.col("id").alias(s), F.col("identity").alias(f"identity_{s}"))
    conflicts = pairs.select("a", "b", "similarity").join(side("a"), "a").join(side("b"), "b").where("identity_a <> identity_b").select("a", "b", "similarity", "identity_a", "identity_b")
    return _grouped(state), conflicts


def merged_entities(entities: DataFrame, least: float = LEAST, scope: tuple[str, ...] = ("active",), rounds: int = ROUNDS) -> DataFrame:
    """groups as in merge_groups, of entities (id, category, name, aliases, status, identity) linked by alias_candidates.

    The links are written once, with the identities of both ends, and never shuffled whole: components come of what each
    task has thinned, and an entity's first identity of a maximum that tasks form before they send it.
    """
    links = materialize(alias_candidates(entities, least, scope, guarded=True).drop("category"), "merge-links")
    return _grouped(_settled(links, _guarded(entities.select("id", "identity")), rounds))


def refused_aliases(entities: DataFrame, groups: DataFrame, least: float = LEAST, scope: tuple[str, ...] = ("active",)) -> DataFrame:
    """conflicts as in merge_groups: alias candidates whose groups have two identities.

    The candidates are found once more with the identities that their entities have in the end, which costs less than to
    look these up for every link.
    """
    ended = entities.drop("identity").join(groups.select("id", "identity"), "id")
    return alias_candidates(ended, least, scope, guarded=True).where("identity_a <> identity_b").drop("category")


def _guarded(identities: DataFrame) -> DataFrame:
    guarded = identities.where("identity IS NOT NULL").select("id", "identity").distinct()
    if guarded.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an entity has two guarded identities")
    return guarded


def _grouped(state: DataFrame) -> DataFrame:
    least = state.groupBy(F.col("root").alias("r"), F.col("identity").alias("i")).agg(F.min("id").alias("group"))
    return state.join(least, (F.col("root") == F.col("r")) & F.col("identity").eqNullSafe(F.col("i"))).select("id", "group", "identity", "divided")


def _settled(pairs: DataFrame, guarded: DataFrame, rounds: int) -> DataFrame:
    """(id, root, identity, divided) of the ends of written pairs (a, b, similarity, identity_a, identity_b) after all rounds."""
    roots = connect(thinned(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    named = roots.select(F.col("u").alias("id"), "root").join(guarded, "id", "left")
    kinds = named.groupBy("root").agg(F.countDistinct("identity").alias("kinds"), F.max("identity").alias("only"))
    known = named.join(kinds, "root").withColumn("identity", F.when(F.col("kinds") <= 1, F.col("only")).otherwise(F.col("identity")))
    state = materialize(known.select("id", "root", "identity", (F.col("kinds") > 1).alias("divided")), "merge-state")
    ways = lambda x, y: pairs.select(F.col(x).alias("id"), F.col(y).alias("near"), "similarity", F.col(f"identity_{x}").alias("mine"), F.col(f"identity_{y}").alias("theirs")).where("mine IS NULL")
    both = ways("a", "b").unionByName(ways("b", "a"))
    near = both.where("theirs IS NOT NULL")
    for _ in range(rounds):
        best = near.groupBy("id").agg(F.max_by("theirs", F.struct("similarity", -F.col("near"))).alias("taken"))
        taken = materialize(best.join(state.where("divided AND identity IS NULL").select("id"), "id", "left_semi"), "merge-round")
        if not taken.limit(1).count():
            break
        state = materialize(state.join(taken, "id", "left").select("id", "root", F.coalesce("identity", "taken").alias("identity"), "divided"), "merge-state")
        open_ = state.where("divided AND identity IS NULL").select("id")
        few = open_.limit(FEW + 1).count() <= FEW
        both = materialize(both.join(F.broadcast(open_) if few else open_, "id", "left_semi").select("id", "near", "similarity"), "merge-open")
        held = state.where("divided AND identity IS NOT NULL").select(F.col("id").alias("near"), F.col("identity").alias("theirs"))
        near = both.join(held, "near")
    else:
        raise RuntimeError("identities did not settle")
    return state
