"""Changesets applied in the order of their entries, without a loop over them.

An entry may add a row, delete one, or edit one and give it another name, and what it finds depends on the entries before it: names are taken
and freed as it goes. Two things make that a matter of joins and windows:

* Whether a name is there before an entry follows from the last entry that is sure to set it. Entries with a second name (``rename_to``)
  are the only ones whose effect can be open. A round decides those for which both names are known, or one of them forbids the entry,
  and its results make more names known. So there are as many rounds as the longest chain of entries that wait for each other, and
  many entries for one name are one round.
* A row's values are those of its last edits. Each edit belongs to the row that holds the name by then; renamed rows point to what they
  were called before, and pointers are doubled until they reach the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergestone.operators.rounds import kept

#: Where the base stands among the entries.
BASE = -1


def _known(asked: DataFrame, effects: DataFrame, scope: list[str]) -> DataFrame:
    """``asked`` (scope, name, seq, ...) with ``there``: whether the name is there before that entry, null if that is open, and ``since``: the
    entry that put it there. ``effects``: (scope, name, seq, state, open)."""
    a = asked.withColumn("__ask", F.lit(True))
    rows = a.unionByName(effects.select(*scope, "name", "seq", "state", "open"), allowMissingColumns=True)
    before = Window.partitionBy(*scope, "name").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    sure = F.max(F.when(~F.col("open"), F.struct("seq", "state"))).over(before)
    last = lambda state: F.max(F.when(F.col("open") & (F.col("state") == state), F.col("seq"))).over(before)
    rows = rows.withColumn("sure", sure).withColumn("may_go", last(False)).withColumn("may_come", last(True)).filter("__ask")
    t = F.coalesce("sure.seq", F.lit(BASE - 1))
    held = F.coalesce("sure.state", F.lit(False))
    there = F.when(held & (F.coalesce("may_go", t) <= t), True).when(~held & (F.coalesce("may_come", t) <= t), False)
    return rows.withColumn("there", there).withColumn("since", F.when(held, F.col("sure.seq"))).drop("__ask", "state", "open", "sure", "may_go", "may_come")


def _needed(asked: DataFrame, sure: DataFrame, scope: list[str]) -> DataFrame:
    """Of ``sure`` effects, those that are the last before some asked entry: nothing that is asked later depends on the others."""
    a = asked.select(*scope, "name", "seq", F.lit(None).cast("boolean").alias("state"), F.lit(True).alias("ask"))
    rows = a.unionByName(sure.select(*scope, "name", "seq", "state", F.lit(False).alias("ask")))
    before = Window.partitionBy(*scope, "name").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    last = rows.withColumn("last", F.max(F.when(~F.col("ask"), F.struct("seq", "state"))).over(before)).filter("ask and last is not null")
    return last.select(*scope, "name", "last.seq", "last.state", F.lit(False).alias("open")).distinct()


def _effects(entries: DataFrame, scope: list[str], is_open: Column) -> DataFrame:
    """What entries do to names: an added one is there after them, a deleted one is not, and a renamed row leaves one for another."""
    e, f = F.lit(True), F.lit(False)
    own = F.struct(F.col("name"), F.col("is_new").alias("state"))
    new = F.struct(F.col("rename_to").alias("name"), e.alias("state"))
    moves = ~F.col("is_new") & ~F.col("is_deleted")
    sets = F.when(moves & F.col("rename_to").isNotNull(), F.array(F.struct(F.col("name"), f.alias("state")), new)).when(~moves, F.array(own))
    return entries.select(*scope, "seq", is_open.alias("open"), F.explode(sets).alias("x")).select(*scope, "x.name", "seq", "x.state", "open")


def applied(base: DataFrame, changes: DataFrame, categories: list[str], scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """UPS3, UPS4: (result, report) of a changeset (name, rename_to, category, price, is_new, is_deleted) on (name, category, price).

    Entries go by ``seq`` if the changeset has it, which must tell them apart, or else as they stand in the table. An entry is skipped, with a
    reason, if its category is unknown, if it adds a name that is there, or changes or deletes one that is not there, or if its new name
    is taken; all by then. Later edits of a row win over earlier ones, and a null category or price changes nothing. A row renamed and
    a name added again are two rows. With ``scope`` columns in both tables, names stand for themselves in each scope. Names of the
    base are distinct."""
    scope = scope or []
    c = changes if "seq" in changes.columns else changes.withColumn("seq", F.monotonically_increasing_id())
    flag = lambda x: F.coalesce(F.col(x), F.lit(False)).alias(x)
    to = F.when(F.col("rename_to") != F.col("name"), F.col("rename_to")).alias("rename_to")
    c = kept(c.select(*scope, F.col("seq").cast("long").alias("seq"), "name", to, "category", "price", flag("is_new"), flag("is_deleted")), "changes")
    good = c.filter(F.col("category").isNull() | F.col("category").isin(categories))
    names = c.select(*scope, "name").unionByName(c.select(*scope, F.col("rename_to").alias("name"))).distinct()
    touched = kept(base.select(*scope, "name", "category", "price").join(names, [*scope, "name"], "left_semi"), "touched")
    yes, no = F.lit(True), F.lit(False)
    there = touched.select(*scope, "name", F.lit(BASE).cast("long").alias("seq"), yes.alias("state"), no.alias("open"))
    plain = there.unionByName(_effects(good.filter("rename_to is null"), scope, no))
    linked = good.filter("rename_to is not null")
    done, left = [], linked.select(*scope, "seq", "name", "rename_to", "is_new", "is_deleted")
    roles = F.array(F.struct(F.col("name"), no.alias("target")), F.struct(F.col("rename_to").alias("name"), yes.alias("target")))
    asking = lambda e: e.select(*scope, "seq", "is_new", F.explode(roles).alias("r")).select(*scope, "seq", "is_new", "r.name", "r.target")
    # a round costs what is left of the entries, not what was decided before
    sure = kept(_needed(asking(left), plain, scope), "sure")
    while True:
        effects = sure.unionByName(_effects(left, scope, yes))
        fits = F.when(F.col("target") | F.col("is_new"), ~F.col("there")).otherwise(F.col("there"))
        # every name fits, or one is known not to
        found = _known(asking(left), effects, scope).groupBy(*scope, "seq").agg(F.when(F.bool_or(~fits), False).when(F.count(fits) == 2, True).alias("ok"))
        decided = kept(left.join(found, [*scope, "seq"]), "decided")
        now, left = decided.filter("ok is not null"), decided.filter("ok is null").drop("ok")
        done.append(now)
        if left.isEmpty():
            break
        sure = kept(_needed(asking(left), sure.unionByName(_effects(now.filter("ok"), scope, no)), scope), "sure")
    done = kept(reduce(DataFrame.unionByName, done), "done")
    settled = plain.unionByName(_effects(done.filter("ok"), scope, no))
    at_name = _known(c, settled, scope).withColumnRenamed("there", "has").drop("since").join(done.select(*scope, "seq", "ok"), [*scope, "seq"], "left")
    bad = F.col("category").isNotNull() & ~F.col("category").isin(categories)
    reason = F.when(bad, "unknown category").when(F.col("is_new") & F.col("has"), "already there").when(~F.col("is_new") & ~F.col("has"), "not there").when(F.col("rename_to").isNotNull() & ~F.col("ok"), "name taken")
    status = F.when(F.col("reason").isNotNull(), "skipped").when(F.col("is_new"), "added").when(F.col("is_deleted"), "deleted").otherwise("kept")
    report = kept(at_name.withColumn("reason", reason).withColumn("status", status), "report")

    # a holder is a name with the entry since which a row has it
    effects = kept(there.unionByName(_effects(report.filter("status <> 'skipped'"), scope, no)), "effects")
    holder = lambda name, seq: F.struct(*scope, F.col(name).alias("name"), F.col(seq).alias("seq"))
    edits = _known(report.filter("status = 'kept'"), effects, scope)
    moved = edits.filter("rename_to is not null").select(holder("rename_to", "seq").alias("holder"), holder("name", "since").alias("root"))
    while True:  # each pass doubles how far a pointer reaches
        further = moved.select(F.col("holder").alias("root"), F.col("root").alias("next"))
        longer = kept(moved.join(further, "root", "left"), "roots")
        moved = longer.select("holder", F.coalesce("next", "root").alias("root"))
        if longer.filter("next is not null").isEmpty():
            break
    first = touched.withColumn("seq", F.lit(BASE).cast("long")).unionByName(report.filter("status = 'added'").select(*touched.columns, "seq"))
    said = edits.select(holder("name", "since").alias("holder"), "seq", "category", "price").join(moved, "holder", "left").select(F.coalesce("root", "holder").alias("root"), "seq", "category", "price")
    newest = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("seq"))).alias(x)
    values = first.select(holder("name", "seq").alias("root"), "seq", "category", "price").unionByName(said).groupBy("root").agg(newest("category"), newest("price"))
    last = effects.groupBy(*scope, "name").agg(F.max(F.struct("seq", "state")).alias("s")).filter("s.state")
    rows = last.select(*scope, "name", "s.seq").select(*scope, "name", holder("name", "seq").alias("holder"))
    rows = rows.join(moved, "holder", "left").select(*scope, "name", F.coalesce("root", "holder").alias("root")).join(values, "root")
    untouched = base.select(*scope, "name", "category", "price").join(names, [*scope, "name"], "left_anti")
    return untouched.unionByName(rows.select(*scope, "name", "category", "price")), report.select(*scope, "seq", "name", "status", "reason")

