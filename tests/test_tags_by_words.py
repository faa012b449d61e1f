"""Tags by words of a text against the patterns alone."""

import random

from pyspark.sql import functions as F

from mergestone.functions import classify as C
from mergestone.functions import vocabulary as V


def by_patterns(t, out, lists):
    for _ in range(2 if out else 0):
        t = F.regexp_replace(t, C.any_of(out), " ")
    return t.rlike(C.any_of(*lists))


def test_words_and_patterns_agree(spark):
    rng = random.Random(3)
    rules = [*C.TAGS.values(), *C.FLAVOURS.values(), *((out, lists) for _, out, lists in C.KINDS)]
    said = sorted({s for out, lists in rules for ws in (out, *lists) for w in ws for s in C.spelt_out(w)} | {s for w in V.NOT_ALCOHOLIC_WORDS for s in C.spelt_out(w)})
    halves = [w for s in said for w in s.replace("-", " ").split(" ")]
    joins = [" ", " ", ", ", "-", "_", "é", "\n", " and "]
    lines = ["".join(x + rng.choice(joins) for x in rng.choices(said if k % 3 else halves, k=rng.randrange(1, 5))) for k in range(600)]
    lines += [*said, "", " ", "Root Beer Root Beer ale", "gluten--friendly", "RYE", "tea !", "tea", "nut", "root beer", "Crème brûlée"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)] + [(-1, None)], "id long, line string")
    t = C.plain(F.coalesce("line", F.lit("")))
    alcohol = by_patterns(t, *C.TAGS["contains_alcohol"]) & ~t.rlike(C.any_of(V.NOT_ALCOHOLIC_WORDS))
    marks = lambda rules: F.array_compact(F.array(*(F.when(alcohol if code == "contains_alcohol" else by_patterns(t, *rule), F.lit(code)) for code, rule in rules.items())))
    kind = F.coalesce(*(F.when(by_patterns(C.plain(F.col("line")), out, lists), F.lit(k)) for k, out, lists in C.KINDS))
    x = F.col("line")
    end = F.when(C.plain(x).rlike(C.DRINK_AT_END), "non_alcoholic_beverage").otherwise("food")
    got = df.select("line", C.dietary_tags(x).alias("a"), marks(C.TAGS).alias("b"), C.flavour_tags(x).alias("c"), marks(C.FLAVOURS).alias("d"), C.alcohol_kind(F.lit("alcoholic_beverage"), x).alias("e"), kind.alias("f"), C.category_of(F.lit("food"), x, F.array(F.lit(""))).alias("g"), end.alias("h")).collect()
    assert not [r for r in got if (r.a, r.c, r.e, r.g) != (r.b, r.d, r.f, r.h)]
    assert {tag for r in got for tag in r.a + r.c} == {*C.TAGS, *C.FLAVOURS}


def test_single_words_need_no_pattern():
    assert C.single_words(("sour ale", "ales?")) == ["ale", "ales"] and C.begins_of_phrases(("sour ale", "ales?")) == ["sour"]
