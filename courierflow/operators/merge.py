"""Batch changes to tables (M1-M4): inserts, patches, line replacement and
deletes, each as DataFrame -> DataFrame (new table version + rejects).

Plain parquet tables are rewritten (join-and-rewrite); on a table format
with MERGE support the same accepted-change DataFrames feed
``DataFrame.mergeInto``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierflow.functions.values import patch_coalesce
from courierflow.operators.ranking import rank_within_key
from courierflow.schema import (REASON_BAD_QUANTITY, REASON_DUP_ITEM, REASON_ITEM_NOT_IN_RESTAURANT,
                                REASON_ORDER_NOT_FOUND, REASON_RESTAURANT_NOT_FOUND, REASON_USER_NOT_FOUND)


def assign_ids(batch: DataFrame, order: list, start_after: DataFrame | int, id_col: str = "id") -> DataFrame:
    """M1 id assignment: ``max(existing id) + 1, + 2, ...`` in ``order``.

    Numbering uses the two-pass range/offset ranking over the whole batch
    (no single-partition global window).  ``start_after`` is the current
    table (its max id is taken) or a number."""
    ranked = rank_within_key(batch.withColumn("_all", F.lit(0)), ["_all"], order, out="_seq").drop("_all")
    if isinstance(start_after, DataFrame):
        # scalar subquery: the current max id, evaluated once
        base = start_after.agg(F.coalesce(F.max(id_col), F.lit(-1))).scalar()
        return ranked.withColumn(id_col, base + F.col("_seq")).drop("_seq")
    return ranked.withColumn(id_col, F.lit(int(start_after)) + F.col("_seq")).drop("_seq")


def apply_inserts(table: DataFrame, checked_batch: DataFrame, order: list, id_col: str = "id") -> DataFrame:
    """M1: append the accepted rows of a checked batch with fresh ids."""
    accepted = checked_batch.where(F.col("reject_reason").isNull()).drop("reject_reason")
    new_rows = assign_ids(accepted, order, table, id_col)
    return table.unionByName(new_rows.select(*table.columns))


def apply_patches(table: DataFrame, patches: DataFrame, key: str, columns: list[str],
                  fk_checks: list[tuple[str, DataFrame, str]] | tuple = (),
                  not_found_reason: str = "Not found.",
                  row_checks: list[tuple[Column, str]] | tuple = ()) -> tuple[DataFrame, DataFrame]:
    """M2: partial updates.  A patch for an unknown id, or whose non-null FK
    value has no parent, or which fails one of ``row_checks`` (condition over the
    patch, reason), is rejected; otherwise non-null patch values replace
    the stored ones (F5).  Returns (new table, rejected patches).

    Patches must be unique per id (reduce or reject repeats first, e.g.
    with ``rules.unique_split``), so the join stays n:1."""
    p = patches
    known = table.select(F.col(key).alias("_k")).withColumn("_known", F.lit(True))
    p = p.join(known, p[key] == known["_k"], "left").drop("_k")
    rules = [(F.col("_known").isNotNull(), not_found_reason)]
    for col, parent, reason in fk_checks:
        par = parent.select(F.col("id").alias(f"_fk_{col}")).withColumn(f"_ok_{col}", F.lit(True))
        p = p.join(par, p[col] == par[f"_fk_{col}"], "left").drop(f"_fk_{col}")
        rules.append((F.col(col).isNull() | F.col(f"_ok_{col}").isNotNull(), reason))
    rules.extend(row_checks)
    reason = None
    for ok, text in rules:
        cond = ~F.coalesce(ok, F.lit(False))
        reason = F.when(cond, F.lit(text)) if reason is None else reason.when(cond, F.lit(text))
    p = p.withColumn("reject_reason", reason)
    helper = [c for c in p.columns if c.startswith("_known") or c.startswith("_ok_")]
    rejected = p.where(F.col("reject_reason").isNotNull()).drop(*helper)
    accepted = p.where(F.col("reject_reason").isNull()).select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    merged = table.join(accepted, key, "left")
    out = merged.select(*[patch_coalesce(f"_p_{c}", c).alias(c) if c in columns else F.col(c)
                          for c in table.columns])
    return out, rejected


def replace_order_items(order_item: DataFrame, patches: DataFrame) -> DataFrame:
    """M3: ``patches`` = (order_id, items array<struct<item_id, quantity>>).
    Null items keep the stored lines; a given list (even empty) replaces all
    lines of that order."""
    replaced = patches.where(F.col("items").isNotNull()).select("order_id")
    kept = order_item.join(replaced, "order_id", "left_anti")
    new_lines = patches.where(F.col("items").isNotNull()).select(
        "order_id", F.explode("items").alias("l")).select(
        "order_id", F.col("l.item_id").alias("item_id"), F.coalesce(F.col("l.quantity"), F.lit(1)).alias("quantity"))
    return kept.unionByName(new_lines.select(*order_item.columns))


def check_order_patches(patches: DataFrame, orders: DataFrame, item: DataFrame,
                        restaurant: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """M2/M3: order patches (order_id, items, and where given restaurant_id and
    user_id) with a ``reject_reason``: every quantity at least 1, the order
    exists, then the new restaurant and the new user, and, line by line, the
    item is not a repeat and belongs to the restaurant that the order has after
    the patch.  Null items are not checked (the lines stay)."""
    o = orders.select(F.col("id").alias("order_id"), F.col("restaurant_id").alias("_rest"))
    known = patches.join(o, "order_id", "left").withColumn("_found", F.col("_rest").isNotNull())
    given = []
    for col, parent, text in (("restaurant_id", restaurant, REASON_RESTAURANT_NOT_FOUND), ("user_id", users, REASON_USER_NOT_FOUND)):
        if col in patches.columns and parent is not None:
            par = parent.select(F.col("id").alias(f"_p_{col}"))
            known = known.join(par, F.col(col) == F.col(f"_p_{col}"), "left")
            given.append((F.col(col).isNotNull() & F.col(f"_p_{col}").isNull(), text))
    if "restaurant_id" in patches.columns:
        known = known.withColumn("_rest", F.coalesce("restaurant_id", "_rest"))
    lines = known.where(F.col("items").isNotNull()).select(
        "order_id", "_rest", F.transform("items", lambda x: x["item_id"]).alias("_ids"), F.posexplode("items").alias("_pos", "_l"))
    i = item.select(F.col("id").alias("_item"), F.col("restaurant_id").alias("_item_rest"))
    repeat = F.array_position("_ids", F.col("_l.item_id")) <= F.col("_pos")
    fail = F.when(repeat, F.struct("_pos", F.lit(REASON_DUP_ITEM).alias("reason"))).when(
        ~F.col("_item_rest").eqNullSafe(F.col("_rest")), F.struct("_pos", F.lit(REASON_ITEM_NOT_IN_RESTAURANT).alias("reason")))
    seen = lines.join(i, lines["_l.item_id"] == F.col("_item"), "left").groupBy("order_id").agg(
        F.min(fail).alias("_fail"), F.bool_or(F.coalesce(F.col("_l.quantity"), F.lit(1)) < 1).alias("_bad_quantity"))
    reason = (F.when(F.col("_bad_quantity"), F.lit(REASON_BAD_QUANTITY))
              .when(~F.col("_found"), F.lit(REASON_ORDER_NOT_FOUND)))
    for missing, text in given:
        reason = reason.when(missing, F.lit(text))
    reason = reason.otherwise(F.col("_fail.reason"))
    return known.join(seen, "order_id", "left").select(*patches.columns, reason.alias("reject_reason"))


def apply_deletes(requests: DataFrame, table: DataFrame, refusing_children: list[tuple[DataFrame, str]],
                  cascades: list[tuple] | tuple = ()) -> DataFrame:
    """M4: delete requests (``id``) against ``table``.  A request is
    ``not found`` when the id is unknown, ``refused`` when a child without
    delete cascade still references it or one of the children that would go
    with it, else ``deleted`` with the number of cascaded child rows.

    ``cascades``: (child, fk) or (child, fk, [(grandchild, fk to child id)]);
    a referenced grandchild's key refuses the whole request, as the foreign
    key without cascade does.  Returns the outcome per request."""
    req = requests.select("id").distinct()
    t = table.select("id").withColumn("_found", F.lit(True))
    out = req.join(t, "id", "left")
    refs = [child.select(F.col(fk).alias("id")) for child, fk in refusing_children]
    n_cascade = F.lit(0).cast("bigint")
    for i, (child, fk, *held_by) in enumerate(cascades):
        cnt = child.groupBy(F.col(fk).alias("id")).agg(F.count(F.lit(1)).alias(f"_n_{i}"))
        out = out.join(cnt, "id", "left")
        n_cascade = n_cascade + F.coalesce(F.col(f"_n_{i}"), F.lit(0))
        for grandchild, child_fk in held_by[0] if held_by else ():
            held = grandchild.select(F.col(child_fk).alias("_child")).distinct()
            refs.append(child.join(held, child["id"] == held["_child"], "left_semi").select(F.col(fk).alias("id")))
    refused = F.lit(False)
    for j, ref in enumerate(refs):
        out = out.join(ref.where(F.col("id").isNotNull()).distinct().withColumn(f"_ref_{j}", F.lit(True)), "id", "left")
        refused = refused | F.col(f"_ref_{j}").isNotNull()
    outcome = (F.when(F.col("_found").isNull(), F.lit("not found"))
               .when(refused, F.lit("refused"))
               .otherwise(F.lit("deleted")))
    return out.select("id", outcome.alias("outcome"),
                      F.when(outcome == "deleted", n_cascade).otherwise(F.lit(0).cast("bigint")).alias("n_cascaded"))


def table_after_deletes(table: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows left after the ``deleted`` outcomes are removed (anti-join)."""
    gone = outcomes.where(F.col("outcome") == "deleted").select("id")
    return table.join(gone, "id", "left_anti")


def children_after_deletes(child: DataFrame, fk: str, outcomes: DataFrame) -> DataFrame:
    """Cascade: child rows whose parent was deleted are removed too."""
    gone = outcomes.where(F.col("outcome") == "deleted").select(F.col("id").alias(fk))
    return child.join(gone, fk, "left_anti")
