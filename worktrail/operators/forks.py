"""Fork trees: label their sessions and drop the records a fork copied.

A walk around a tree enters and leaves each session once; a session's span
between the two holds the spans of all its descendants. So "some ancestor holds
this record" is a question of spans, answered by one ordered scan over the
holders of a record, and no pair of session and ancestor is ever written.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.operators.scan import SEQ_CHUNK, by_width, ordered_scan
from worktrail.session import materialise


def parent_links(header: DataFrame, logs: DataFrame | None = None) -> DataFrame:
    """(session_id, parent) with the parent as a session id.

    The header names the parent by id or by the path of its log; the id is in
    the file name. Links to logs that are not there end the walk.
    """
    named = header.where("parent_session is not null and parent_session <> ''")
    base = F.regexp_extract("parent_session", r"([^/]+?)(?:\.jsonl)?$", 1)
    after = F.regexp_extract(base, r"^[^_]*_(.*)$", 1)
    from_path = F.when(base.contains("_"), after).otherwise(base)
    parent = F.when(F.col("parent_session").contains("/"), from_path).otherwise(F.col("parent_session"))
    links = named.select("session_id", parent.alias("parent")).where("session_id <> parent").distinct()
    known = header if logs is None else logs
    return links.join(known.select(F.col("session_id").alias("parent")).distinct(), "parent", "left_semi").select(
        "session_id", "parent"
    )


def ancestors(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(session_id, ancestor) for every ancestor of every session.

    Distances double each round, so a chain of length d takes log2(d) joins.
    A round's result is checkpointed: the plan stays short, and a lost
    executor does not replay earlier rounds. A cycle ends because pairs are
    distinct and a session is never its own ancestor.
    """
    reach = links.select("session_id", F.col("parent").alias("ancestor")).distinct()
    reach = materialise(reach)
    size = reach.count()
    for _ in range(max_rounds):
        further = reach.select("session_id", F.col("ancestor").alias("via")).join(
            reach.select(F.col("session_id").alias("via"), "ancestor"), "via"
        ).select("session_id", "ancestor").where("session_id <> ancestor")
        grown = materialise(reach.union(further).distinct())
        total = grown.count()
        if total == size:
            return reach
        reach, size = grown, total
    raise ValueError("fork chains did not close")


def _tours(links: DataFrame) -> DataFrame:
    """Steps (at, next, steps, done) of the walk around each tree.

    Walks go down to the first child, on to the next sibling and back up; the
    last step, leaving the root, is its own next one. Siblings come in order of
    a hash, so a parent of very many children is spread over tasks.
    """
    h = F.pmod(F.xxhash64("session_id"), F.lit(1 << 20))
    children = materialise(links.groupBy("session_id").agg(F.min("parent").alias("parent")).withColumn("h", h))
    enter, leave = (lambda c, m=m: F.concat(F.lit(m), F.col(c)) for m in "<>")
    first = children.groupBy("parent").agg(F.min_by("session_id", F.struct("h", "session_id")).alias("child"))
    sibling = ordered_scan(children, ["parent"], ["h", "session_id"], by_width("h", 1 << 10), next_={"sibling": F.col("session_id")})
    nodes = children.select("session_id").union(children.select("parent")).distinct()
    down = nodes.join(first.withColumnRenamed("parent", "session_id"), "session_id", "left").select(
        enter("session_id").alias("at"), F.coalesce(enter("child"), leave("session_id")).alias("next"), F.lit(1).cast("bigint").alias("steps")
    )
    up = nodes.join(sibling, "session_id", "left").select(
        leave("session_id").alias("at"), F.coalesce(enter("sibling"), leave("parent"), leave("session_id")).alias("next"),
        F.col("parent").isNotNull().cast("bigint").alias("steps"),
    )
    return down.unionByName(up).withColumn("done", F.col("steps") == 0)


def _ranked(tours: DataFrame) -> DataFrame:
    """Each step with its distance to the end of the walk and that end.

    Distances double with each round. Steps whose next one is an end are done
    and move no more. Walks that never end, below a cycle, stay undone.
    """
    steps = materialise(tours)
    rounds = math.ceil(math.log2(max(2, steps.count()))) + 1
    finished = steps.where("done")
    open_ = steps.where("not done")
    for _ in range(rounds):
        if open_.isEmpty():
            break
        ahead = finished.unionByName(open_).select(F.col("at").alias("next"), F.col("next").alias("next2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
        moved = materialise(open_.join(ahead, "next").select("at", F.col("next2").alias("next"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("done2").alias("done")))
        finished = finished.unionByName(moved.where("done"))
        open_ = moved.where("not done")
    return finished.unionByName(open_)


def _cycles(links: DataFrame) -> DataFrame:
    """(session_id, ring): sessions on a cycle of parents and its smallest id.

    Jumps double; after as many as there are sessions every jump of an endless
    walk lands on a cycle, and has seen all of it.
    """
    hops = materialise(links.select("session_id", F.col("parent").alias("to"), F.col("parent").alias("low")))
    for _ in range(math.ceil(math.log2(max(2, hops.count()))) + 1):
        on = hops.select(F.col("session_id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        hops = materialise(hops.join(on, "to").select("session_id", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
    ring = hops.select(F.col("to").alias("session_id")).distinct()
    return hops.join(ring, "session_id", "left_semi").select("session_id", F.col("low").alias("ring"))


def fork_trees(links: DataFrame) -> DataFrame:
    """(session_id, root, enter, leave) of every session that forks or was forked.

    `enter` and `leave` rise along the walk around the tree: a session lies below
    another of its root if its span lies inside. Sessions on a cycle of parents
    share one span, as each is above all others. Rows stay linear in the links;
    a chain of d forks takes log2(d) rounds.
    """
    links = links.select("session_id", "parent")
    ranked = _ranked(_tours(links))
    undone = ranked.where("not done")
    rings = None
    if not undone.isEmpty():
        lost = undone.select(F.substring("at", 2, 1 << 30).alias("session_id")).distinct()
        rings = materialise(_cycles(links.join(lost, "session_id", "left_semi").groupBy("session_id").agg(F.min("parent").alias("parent"))))
        hung = links.join(rings.select("session_id"), "session_id", "left_anti").join(
            rings.withColumnRenamed("session_id", "parent"), "parent", "left"
        ).select("session_id", F.coalesce("ring", "parent").alias("parent"))
        # A ring that nothing hangs on still needs its own two steps.
        alone = rings.groupBy("ring").agg(F.count("*").alias("n")).select(F.explode(F.array(
            F.struct(F.concat(F.lit("<"), "ring").alias("at"), F.concat(F.lit(">"), "ring").alias("next"), F.lit(1).cast("bigint").alias("steps"), F.lit(False).alias("done")),
            F.struct(F.concat(F.lit(">"), "ring").alias("at"), F.concat(F.lit(">"), "ring").alias("next"), F.lit(0).cast("bigint").alias("steps"), F.lit(True).alias("done")),
        )).alias("s")).select("s.*")
        tours = materialise(_tours(hung))
        ranked = _ranked(tours.unionByName(alone.join(tours.select("at"), "at", "left_anti")))
    node, mark = F.substring("at", 2, 1 << 30), F.substring("at", 1, 1)
    trees = ranked.groupBy(node.alias("session_id")).agg(
        F.first(F.substring("next", 2, 1 << 30)).alias("root"),
        F.max(F.when(mark == "<", -F.col("steps"))).alias("enter"), F.max(F.when(mark == ">", -F.col("steps"))).alias("leave"),
    )
    if rings is None:
        return trees
    members = rings.join(trees.withColumnRenamed("session_id", "ring"), "ring").drop("ring").select(trees.columns)
    return trees.join(rings, "session_id", "left_anti").unionByName(members)


def copied_records(records: DataFrame, trees: DataFrame) -> DataFrame:
    """(session_id, sidecar_name, rec_id) of records some ancestor already holds.

    Primary logs and sidecars go through one path: a sidecar is compared with
    the ancestors' sidecar of the same relative name. The holders of a record in
    one tree are scanned in the order of the walk: one of them is an ancestor if
    its span is still open.
    """
    slot = ["root", "sidecar_name", "rec_id"]
    ids = records.where("rec_id is not null").select("session_id", "sidecar_name", "rec_id").distinct().join(trees, "session_id")
    # Only ids that two sessions of a tree hold can be copies.
    shared = ids.groupBy(*slot).agg(F.min("session_id").alias("a"), F.max("session_id").alias("b")).where("a <> b").select(*slot)
    held = materialise(ids.join(shared, slot, "left_semi"))
    scanned = ordered_scan(
        held, slot, ["enter", "session_id"], by_width("enter", SEQ_CHUNK), maxs={"open": F.col("leave")}, next_={"twin": F.col("enter")}
    )
    below = F.coalesce(F.col("open") > F.col("enter"), F.lit(False)) | F.coalesce(F.col("twin") == F.col("enter"), F.lit(False))
    return scanned.where(below).select("session_id", "sidecar_name", "rec_id")


def drop_copied(records: DataFrame, trees: DataFrame) -> DataFrame:
    """Records without those copied from an ancestor; id-less records stay."""
    return records.join(copied_records(records, trees), ["session_id", "sidecar_name", "rec_id"], "left_anti")
