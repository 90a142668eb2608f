"""Parent-child links to full hierarchies: root, depth, path, descendants, loops.

The nodes are cut into fragments of bounded size. Within a fragment every parent chain is contracted to
its exit, the first ancestor that lies in another fragment. The nodes other fragments point at, with
their contracted chains as single steps, form a smaller forest of the same kind (the quotient), which is
solved by the same function; its results are then expanded over the fragments. Loops inside a fragment
are found while contracting, loops across fragments turn up as loops of the quotient.

Scale: a scope of at most ``FRAGMENT`` nodes lies in one fragment, so usually there is no quotient and the
forest costs one shuffle. Of a larger scope only runs of only children are kept together: runs are cut at
random heads, and every node finds the head of its run by jumping over ``JUMPS`` doubled links. What is left
for the quotient are the nodes with several children that lead on, fewer than there are leaves, and one node
of every run, about a third of them: a level leaves half of the nodes or less, chains, loops, combs and stars
alike, so the levels grow with the logarithm of the scope. Memory of a task is bounded by the fragment size,
whatever one scope or one parent holds.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, ship

#: Nodes of a fragment.
FRAGMENT = 100_000
#: One node of so many is a head that ends a run, and runs reach over 2 ** JUMPS links.
HEADS, JUMPS = 4, 3

_SOLVED = "scope bigint, node bigint, root bigint, steps bigint, path string, total bigint, state string"
_LOCAL = "part bigint, frag bigint, scope bigint, node bigint, parent bigint, root_node bigint, hop bigint, hop_path string, weight bigint, fixed string, top bigint, exit bigint, root bigint, steps bigint, path string, total bigint, state string"
TREE, CYCLE, UNDER = "tree", "cycle", "under_cycle"


def _contract(pdf: pd.DataFrame) -> dict[str, list]:
    """Chains of some whole fragments. ``steps`` and ``path`` count from the top of the local chain, ``total`` sums the
    weights of the local subtree. ``exit`` is the parent of the top where that lies outside."""
    frag, scope, node, parent = pdf["frag"].tolist(), pdf["scope"].tolist(), pdf["node"].tolist(), pdf["parent"].astype(object).where(pdf["parent"].notna(), None).tolist()
    hop, hop_path, weight, fixed, root_node = (pdf[c].tolist() for c in ("hop", "hop_path", "weight", "fixed", "root_node"))
    n = len(node)
    at = {k: i for i, k in enumerate(zip(frag, scope, node, strict=True))}
    up = [-1] * n
    exits: list[int | None] = [None] * n
    kids: dict[int, list[int]] = {}
    order: list[int] = []
    for i in range(n):
        if parent[i] is None:
            order.append(i)
            continue
        j = at.get((frag[i], scope[i], int(parent[i])), -1)
        if j < 0:
            exits[i] = int(parent[i])
            order.append(i)
        else:
            up[i] = j
            kids.setdefault(j, []).append(i)
    top, steps, path, state = [-1] * n, [0] * n, [""] * n, [""] * n
    k = 0
    while k < len(order):  # downwards from the tops
        i = order[k]
        k += 1
        j = up[i]
        if j < 0:
            top[i], steps[i], path[i] = i, hop[i], hop_path[i]
            state[i] = fixed[i] or TREE
        else:
            top[i], steps[i], path[i] = top[j], steps[j] + hop[i], f"{path[j]}/{hop_path[i]}"
            state[i] = TREE if state[j] == TREE else UNDER
        order.extend(kids.get(i, ()))
    for i in range(n):  # what no top reaches lies in or below a loop
        if state[i]:
            continue
        walk, seen = i, set()
        while not state[walk] and walk not in seen:
            seen.add(walk)
            walk = up[walk]
        if not state[walk]:
            first = walk
            while True:
                state[walk] = CYCLE
                walk = up[walk]
                if walk == first:
                    break
        walk = i
        while not state[walk]:
            state[walk] = UNDER
            walk = up[walk]
    total = list(weight)
    for i in reversed(order):
        if up[i] >= 0:
            total[up[i]] += total[i]
    return {
        "up": up, "kids": kids, "order": order, "at": at, "top_index": top,
        "top": [node[t] if t >= 0 else None for t in top], "exit": [exits[t] if t >= 0 else None for t in top],
        "root": [root_node[t] if t >= 0 else -1 for t in top], "steps": steps, "path": path, "total": total, "state": state,
    }


_COLUMNS = ("top", "exit", "root", "steps", "path", "total", "state")


def _contracted(pdf: pd.DataFrame) -> pd.DataFrame:
    done = _contract(pdf)
    out = pdf[["part", "frag", "scope", "node", "parent", "root_node", "hop", "hop_path", "weight", "fixed"]].copy()
    for c in _COLUMNS:
        out[c] = pd.Series(done[c], index=out.index, dtype=None if c in ("path", "state") else "Int64")
    return out


def _expanded(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes (kind n) of whole fragments with the solved entries (e) and exits (x) of its quotient."""
    own = pdf[pdf["kind"] == "n"].reset_index(drop=True)
    entries, exits = pdf[pdf["kind"] == "e"], pdf[pdf["kind"] == "x"]
    done = _contract(own)
    up, order, at = done["up"], done["order"], done["at"]
    frag, scope, path, state, steps, root = own["frag"].tolist(), own["scope"].tolist(), done["path"], done["state"], done["steps"], done["root"]
    extra = [0] * len(own)
    looped: set[int] = set()
    for f, s, node, total, st in zip(entries["frag"], entries["scope"], entries["node"], entries["total"], entries["state"], strict=True):
        i = at[(f, s, node)]
        extra[i] += int(total)
        if st == CYCLE:
            looped.add(i)
    for i in reversed(order):
        if up[i] >= 0:
            extra[up[i]] += extra[i]
    solved = {(f, s, x): (r, d, p, st) for f, s, x, r, d, p, st in zip(exits["frag"], exits["scope"], exits["node"], exits["root"], exits["steps"], exits["path"], exits["state"], strict=True)}
    on_loop = set()
    for i in looped:
        while i >= 0 and i not in on_loop:
            on_loop.add(i)
            i = up[i]
    for i in range(len(own)):
        beyond = solved.get((frag[i], scope[i], done["exit"][i])) if done["exit"][i] is not None else None
        if beyond is None:
            continue
        r, d, p, st = beyond
        if st == TREE:
            root[i], steps[i], path[i] = int(r), steps[i] + int(d), f"{p}/{path[i]}"
        else:
            state[i] = CYCLE if i in on_loop else UNDER
    total = [t + e for t, e in zip(done["total"], extra, strict=True)]
    return pd.DataFrame({"scope": scope, "node": own["node"], "root": root, "steps": steps, "path": path, "total": total, "state": state})


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """(scope, node, run): only children have the run of their parent, unless they are heads, drawn anew on every level."""
    only = nodes.where("parent is not null").groupBy("scope", "parent").agg(F.count(F.lit(1)).alias("kids")).where("kids = 1").select("scope", "parent", F.lit(True).alias("only"))
    drawn = F.pmod(F.xxhash64("node", F.lit(level), F.lit("head")), F.lit(HEADS)) == 0
    runs = nodes.select("scope", "node", "parent").join(only, ["scope", "parent"], "left")
    runs = cut(runs.select("scope", "node", F.when(F.col("only") & ~drawn, F.col("parent")).otherwise(F.col("node")).alias("run")))
    for _ in range(JUMPS):
        further = runs.where("run <> node").select("scope", F.col("node").alias("run"), F.col("run").alias("further"))
        runs = cut(runs.join(further, ["scope", "run"], "left").select("scope", "node", F.coalesce("further", "run").alias("run")))
    return runs


def _fragments(nodes: DataFrame, limit: int, level: int) -> tuple[DataFrame, bool]:
    """Add ``frag`` and ``part``, the task it goes to; whether any scope had to be divided."""
    sizes = nodes.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    stats = sizes.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    total = stats["all"] or 0
    buckets = max(1, -(-total * 2 // limit), min(64, total // 2000))
    # small fragments share a task
    part = F.pmod("frag", F.lit(min(buckets, max(64, total * 2 // FRAGMENT)))).alias("part")
    whole = F.pmod(F.xxhash64("scope", F.lit(level)), F.lit(buckets))
    if (stats["most"] or 0) <= limit:
        return nodes.withColumn("frag", whole).select("*", part), False
    large = sizes.where(F.col("n") > limit).select("scope", F.ceil(F.col("n") * 2 / limit).cast("bigint").alias("parts"))
    runs = _runs(nodes.join(large, "scope", "left_semi"), level).join(large, "scope")
    spread = -1 - F.pmod(F.xxhash64("scope", F.pmod(F.xxhash64("run", F.lit(level)), F.col("parts"))), F.lit(1 << 62))
    placed = nodes.join(runs.select("scope", "node", spread.alias("frag")), ["scope", "node"], "left")
    return placed.withColumn("frag", F.coalesce("frag", whole)).select("*", part), True


def _solve(nodes: DataFrame, limit: int, level: int, seen: list | None = None) -> DataFrame:
    if seen is not None:
        seen.append(nodes.count())
    nodes, divided = _fragments(nodes, limit, level)
    local = nodes.groupBy("part").applyInPandas(_contracted, _LOCAL)
    if not divided:
        return local.select("scope", "node", "root", "steps", "path", "total", "state")
    local = cut(local)
    home = ("part", "frag")
    tops = local.where("exit is not null and node = top").select(*home, "scope", F.col("exit").alias("node"), "total")
    targets = tops.groupBy("scope", "node").agg(F.sum("total").alias("weight"))
    entries = targets.join(local.select("scope", "node", *home, "root", "steps", "path", "state", F.col("exit").alias("parent")), ["scope", "node"])
    quotient = cut(
        entries.select(
            "scope", "node", "parent", F.col("root").alias("root_node"), F.col("steps").alias("hop"), F.col("path").alias("hop_path"), "weight",
            F.when(F.col("state") != TREE, F.col("state")).alias("fixed"), *home,
        )
    )
    solved = cut(_solve(quotient.drop(*home), limit, level + 1, seen))
    own = local.select(*home, F.lit("n").alias("kind"), "scope", "node", "parent", "root_node", "hop", "hop_path", "weight", "fixed", *[F.lit(None).cast(t).alias(c) for c, t in (("root", "bigint"), ("steps", "bigint"), ("path", "string"), ("total", "bigint"), ("state", "string"))])
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("parent", "bigint"), ("root_node", "bigint"), ("hop", "bigint"), ("hop_path", "string"), ("weight", "bigint"), ("fixed", "string"))]
    results = ("root", "steps", "path", "total", "state")
    into = solved.join(quotient.select("scope", "node", *home), ["scope", "node"]).select(*home, F.lit("e").alias("kind"), "scope", "node", *blank, *results)
    beyond = tops.select(*home, "scope", "node").distinct().join(solved, ["scope", "node"]).select(*home, F.lit("x").alias("kind"), "scope", "node", *blank, *results)
    return own.unionByName(into).unionByName(beyond).groupBy("part").applyInPandas(_expanded, _SOLVED)


def resolve_forest(links: DataFrame, *, fragment: int = FRAGMENT, levels: list[int] | None = None) -> DataFrame:
    """(scope, node, root, depth, path, n_descendants, state) of every node of ``links`` (scope, node, parent).

    A node must occur once; a parent that is null or no node of the scope makes a root. state is ``cycle`` for a
    node that is its own ancestor, ``under_cycle`` for another below one, else ``tree``; only tree nodes have a
    root, depth, path (ids joined by ``/``) and count of descendants, the others -1, -1, '' and -1. ``levels`` takes
    the number of nodes of every level.
    """
    ship(links.sparkSession)
    spark_links = links.select(F.col("scope").cast("bigint").alias("scope"), F.col("node").cast("bigint").alias("node"), F.col("parent").cast("bigint").alias("parent"))
    nodes = cut(
        spark_links.select(
            "scope", "node", "parent", F.col("node").alias("root_node"), F.lit(1).cast("bigint").alias("hop"), F.col("node").cast("string").alias("hop_path"),
            F.lit(1).cast("bigint").alias("weight"), F.lit(None).cast("string").alias("fixed"),
        )
    )
    tree = F.col("state") == TREE
    solved = _solve(nodes, fragment, 0, levels)
    return solved.select(
        "scope", "node", F.when(tree, F.col("root")).otherwise(-1).alias("root"), F.when(tree, F.col("steps") - 1).otherwise(-1).alias("depth"),
        F.when(tree, F.col("path")).otherwise("").alias("path"), F.when(tree, F.col("total") - 1).otherwise(-1).alias("n_descendants"), "state",
    )


def container_links(df: DataFrame, *, scope: str, key: str, parent: str, children: str, seen_at: str) -> DataFrame:
    """(scope, node, parent) of records that name their parent, their children or both.

    Of each (scope, key) the latest delivery counts, of equally late ones the greatest by parent, then children.
    Nodes are the records and all non-null children. The named parent counts, else the record that lists the
    node, of several the smallest; one that is no record counts as none. Rows without scope or key are no records.
    """
    latest = (
        df.select(df[scope].alias("scope"), df[key].alias("node"), F.struct(df[seen_at].alias("t"), df[parent].alias("parent"), df[children].alias("children")).alias("v"))
        .where("scope is not null and node is not null")
        .groupBy("scope", "node")
        .agg(F.max("v").alias("v"))
        .select("scope", "node", "v.parent", "v.children")
    )
    latest = cut(latest)
    records = latest.select("scope", F.col("node").alias("parent"))
    named = latest.where("parent is not null").select("scope", "node", "parent").join(records.withColumn("held", F.lit(True)), ["scope", "parent"], "left")
    own = named.select("scope", "node", F.lit(True).alias("named"), F.when(F.col("held"), F.col("parent")).alias("parent"), F.lit(None).cast("bigint").alias("lister"))
    free = latest.where("parent is null").select("scope", "node", F.lit(False).alias("named"), F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("lister"))
    listed = latest.select("scope", F.explode("children").alias("child"), "node").where("child is not null").select("scope", F.col("child").alias("node"), F.lit(False).alias("named"), F.lit(None).cast("bigint").alias("parent"), F.col("node").alias("lister"))
    merged = own.unionByName(free).unionByName(listed).groupBy("scope", "node").agg(F.max("named").alias("named"), F.max("parent").alias("parent"), F.min("lister").alias("lister"))
    return merged.select("scope", "node", F.when(F.col("named"), F.col("parent")).otherwise(F.col("lister")).alias("parent"))


def descendants(solved: Iterable | DataFrame) -> DataFrame:
    """All (scope, ancestor, node, distance) pairs of tree nodes, from the paths, without any join."""
    ids = F.split("path", "/")
    pairs = solved.where(F.col("state") == TREE).select("scope", "node", "depth", F.posexplode(ids).alias("pos", "ancestor")).where(F.col("pos") < F.col("depth"))
    return pairs.select("scope", F.col("ancestor").cast("bigint").alias("ancestor"), "node", (F.col("depth") - F.col("pos")).alias("distance"))
