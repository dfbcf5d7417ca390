"""Name lexicon and the augmentations that use it."""

from pyspark.sql import Column, DataFrame, functions as F

from antecede.functions.numeric import coin, hash_int, hash_key
from antecede.operators.folds import SEED
from antecede.operators.joins import name_gender_lookup, pronoun_gender
from antecede.operators.ranks import rank_within


def name_gender_lexicon(df: DataFrame) -> DataFrame:
    """Distinct (name, gender) of the candidate the pronoun refers to; A before B."""
    name = F.when(F.col("a_coref"), F.lower("a")).when(F.col("b_coref"), F.lower("b"))
    named = pronoun_gender(df.select("pronoun", name.alias("name")))
    return named.filter(F.col("name").isNotNull()).select("name", "gender").distinct()


def mask_span_augment(
    df: DataFrame, p: float = 0.5, seed: int = SEED, epoch: int = 0
) -> DataFrame:
    """Overwrite the ids of name A by 1 and, independently, of name B by 2.

    ``ids`` starts with ``[CLS]``, so a span at token i is at place i + 1.
    """
    ids = F.col("ids")
    for slot, value in (("a", 1), ("b", 2)):
        flip = coin(p, f"{seed}|{epoch}", F.col("id"), F.lit(slot.upper()))
        ids = F.when(flip, _overwrite(ids, slot, value)).otherwise(ids)
    return df.withColumn("ids", ids)


def _overwrite(ids: Column, slot: str, value: int) -> Column:
    first, last = F.col("spans")[f"{slot}_start"] + 1, F.col("spans")[f"{slot}_end"] + 1
    return F.transform(ids, lambda t, i: F.when(i.between(first, last), value).otherwise(t))


def name_swap_augment(
    df: DataFrame, lexicon: DataFrame, p: float = 0.5, seed: int = SEED
) -> DataFrame:
    """Replace names by others of their gender and move the offsets behind them.

    A row whose mentions overlap keeps its text. The choice is a seeded pick among the
    names of the gender, so only ids and names are shuffled before the last join.
    """
    names = lexicon.withColumn("_hash", hash_key(seed, F.col("name")))
    pool = rank_within(
        names, ["gender"], ["_hash", "name"], F.substr("_hash", F.lit(1), F.lit(3)), "pick"
    ).select("gender", (F.col("pick") - 1).alias("pick"), F.col("name").alias("replacement"))
    sizes = lexicon.groupBy("gender").agg(F.count("name").alias("_names"))

    chosen = (
        name_gender_lookup(df, lexicon)
        .filter(F.col("gender").isNotNull() & coin(p, seed, F.col("id"), F.col("slot")))
        .join(F.broadcast(sizes), "gender")
        .withColumn("pick", hash_int(f"{seed}|pick", F.col("id"), F.col("slot")) % F.col("_names"))
        .join(pool, ["gender", "pick"])
        .groupBy("id")
        .agg(
            F.max(F.when(F.col("slot") == "A", F.col("replacement"))).alias("_new_a"),
            F.max(F.when(F.col("slot") == "B", F.col("replacement"))).alias("_new_b"),
        )
    )

    swapped = df.join(chosen, "id", "left")
    points = F.array_sort(
        F.array(
            F.struct(F.col("a_off").alias("off"), F.length("a").alias("len")),
            F.struct(F.col("b_off").alias("off"), F.length("b").alias("len")),
            F.struct(F.col("p_off").alias("off"), F.length("pronoun").alias("len")),
        )
    )
    swapped = swapped.withColumn("_points", points)
    apart = (
        F.col("_points")[0]["off"] + F.col("_points")[0]["len"] <= F.col("_points")[1]["off"]
    ) & (F.col("_points")[1]["off"] + F.col("_points")[1]["len"] <= F.col("_points")[2]["off"])
    new_a = F.when(apart, F.coalesce("_new_a", "a")).otherwise(F.col("a"))
    new_b = F.when(apart, F.coalesce("_new_b", "b")).otherwise(F.col("b"))
    swapped = swapped.withColumns({"_a": new_a, "_b": new_b})

    grow_a, grow_b = F.length("_a") - F.length("a"), F.length("_b") - F.length("b")
    a_off, b_off, p_off = F.col("a_off"), F.col("b_off"), F.col("p_off")

    def put(text, new, off, old):
        return F.overlay(text, new, off + 1, F.length(old))

    text = F.col("text")
    a_then_b = put(put(text, F.col("_b"), b_off, "b"), F.col("_a"), a_off, "a")
    b_then_a = put(put(text, F.col("_a"), a_off, "a"), F.col("_b"), b_off, "b")
    changed = {
        "text": F.when(a_off < b_off, a_then_b).otherwise(b_then_a),
        "a_off": a_off + F.when(b_off < a_off, grow_b).otherwise(0),
        "b_off": b_off + F.when(a_off < b_off, grow_a).otherwise(0),
        "p_off": p_off
        + F.when(a_off < p_off, grow_a).otherwise(0)
        + F.when(b_off < p_off, grow_b).otherwise(0),
        "a": F.col("_a"),
        "b": F.col("_b"),
    }
    return swapped.select(*[changed.get(c, F.col(c)).alias(c) for c in df.columns])
