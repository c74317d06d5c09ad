"""A temporal fact graph: entities and facts with closed validity intervals of ISO dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_id(name: Column) -> Column:
    """The id of a name: lower case, spaces to underscores, apostrophes dropped."""
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def valid_at(facts: DataFrame, as_of: str) -> DataFrame:
    """Facts whose interval contains the date; strings compare as the dates do."""
    return facts.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= as_of)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of)))


def about(facts: DataFrame, entities: DataFrame, name: str, direction: str = "outgoing", as_of: str | None = None) -> DataFrame:
    """direction, subject, predicate, object, valid_from, valid_to, current of one entity, with display names."""
    facts = valid_at(facts, as_of) if as_of else facts
    names = entities.select(F.col("id").alias("eid"), "name")
    key, shown = entity_id(F.lit(name)), F.col("name")
    cols = lambda way, s, o: [F.lit(way).alias("direction"), s.alias("subject"), "predicate", o.alias("object"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current")]
    out = facts.filter(F.col("subject") == key).join(names, F.col("object") == F.col("eid")).select(*cols("outgoing", F.lit(name), shown))
    into = facts.filter(F.col("object") == key).join(names, F.col("subject") == F.col("eid")).select(*cols("incoming", shown, F.lit(name)))
    return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]


def relation(facts: DataFrame, entities: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    """subject, predicate, object, valid_from, valid_to of one predicate, with display names."""
    facts = (valid_at(facts, as_of) if as_of else facts).filter(F.col("predicate") == predicate)
    side = lambda c: entities.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    joined = facts.join(side("s"), F.col("subject") == F.col("s_id")).join(side("o"), F.col("object") == F.col("o_id"))
    return joined.select(F.col("s_name").alias("subject"), "predicate", F.col("o_name").alias("object"), "valid_from", "valid_to")


def timeline(facts: DataFrame, limit: int = 100) -> DataFrame:
    """Facts by their first day, unknown ones last."""
    return facts.orderBy(F.asc_nulls_last("valid_from"), "subject", "predicate", "object").limit(limit)


def invalidate(facts: DataFrame, subject: str, predicate: str, object_: str, ended: str) -> DataFrame:
    """Close the open facts of a triple."""
    hit = (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == object_) & F.col("valid_to").isNull()
    return facts.withColumn("valid_to", F.when(hit, F.lit(ended)).otherwise(F.col("valid_to")))


def open_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("valid_to").isNull())


def add_facts(facts: DataFrame, new: DataFrame) -> DataFrame:
    """facts with those of new that aren't open already.

    Of new rows of one triple the first by valid_from is added (unknown first), and later ones only once that one is
    closed: the open ones among them are repeats.
    """
    keys = ["subject", "predicate", "object"]
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("valid_from"), F.asc_nulls_last("valid_to"))
    before = F.count_if(F.col("valid_to").isNull()).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = new.withColumn("open_before", F.coalesce(before, F.lit(0))).filter("open_before = 0").drop("open_before")
    return facts.unionByName(first.join(open_facts(facts).select(keys).distinct(), keys, "left_anti"))


def fact_id(subject: Column, predicate: Column, object_: Column, valid_from: Column) -> Column:
    """An id that depends on the fact alone, so that a rerun gives the same."""
    tail = F.substring(F.sha2(F.coalesce(valid_from, F.lit("")), 256), 1, 12)
    return F.concat_ws("_", F.lit("t"), subject, predicate, object_, tail)


def named_facts(rows: DataFrame) -> DataFrame:
    """rows(subject, predicate, object, ...) of display names with ids in their place, and fact_id."""
    key = F.replace(F.lower("predicate"), F.lit(" "), F.lit("_"))
    rows = rows.withColumn("subject", entity_id(F.col("subject"))).withColumn("object", entity_id(F.col("object"))).withColumn("predicate", key)
    return rows.withColumn("fact_id", fact_id(F.col("subject"), F.col("predicate"), F.col("object"), F.col("valid_from")))


def add_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """entities(id, name, type) with those of new(name, type), which replace equal ids; of repeated new ids the least name stays."""
    rows = new.select(entity_id(F.col("name")).alias("id"), "name", F.coalesce("type", F.lit("unknown")).alias("type"))
    rows = rows.groupBy("id").agg(F.min(F.struct("name", "type")).alias("e")).select("id", "e.*")
    return entities.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def add_missing_entities(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """entities(id, name, type) with an unknown one for each name in subject or object of facts that it lacks."""
    names = facts.select(F.col("subject").alias("name")).unionByName(facts.select(F.col("object").alias("name")))
    rows = names.select(entity_id(F.col("name")).alias("id"), "name").groupBy("id").agg(F.min("name").alias("name")).withColumn("type", F.lit("unknown"))
    return entities.unionByName(rows.join(entities.select("id"), "id", "left_anti"))


def seed(people: DataFrame) -> DataFrame:
    """Facts (subject, predicate, object, valid_from, valid_to) of people(name, type, parent, partner, siblings, interests, born).

    One projection a relation; the interests are exploded.
    """
    name, unknown = F.col("name"), F.lit(None).cast("string")

    def fact(predicate: str, object_: Column, rows: DataFrame = people) -> DataFrame:
        return rows.select(name.alias("subject"), F.lit(predicate).alias("predicate"), object_.alias("object"), (F.col("born") if predicate == "child_of" else unknown).alias("valid_from"), unknown.alias("valid_to")).filter("object is not null")

    out = fact("child_of", F.col("parent")).unionByName(fact("married_to", F.col("partner")))
    for predicate, many in (("sibling_of", "siblings"), ("loves", "interests")):
        out = out.unionByName(fact(predicate, F.col("each"), people.withColumn("each", F.explode(many))))
    return out.unionByName(fact("is_a", F.col("type")))


def stats(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """entities, facts, current, expired, predicates (sorted)."""
    n = facts.agg(F.count("*").alias("facts"), F.count_if(F.col("valid_to").isNull()).alias("current"), F.count_if(F.col("valid_to").isNotNull()).alias("expired"), F.array_sort(F.collect_set("predicate")).alias("predicates"))
    return entities.agg(F.count("*").alias("entities")).crossJoin(n)
