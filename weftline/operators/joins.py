"""Operators with several inputs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import columns as C
from weftline.operators import ordered as O
from weftline.operators import pieces as P
from weftline.session import cut, ship

#: A side is sent to all tasks only if it was measured to be at most this large.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20
#: Rules of a replacement that are made expressions; more become automata, each of so many bytes of rules.
EXPRESSIONS, AUTOMATON_BYTES = 32, 4 << 20
#: Rules of about so many bytes are sent to all tasks; of more, only those that occur are looked up.
SENT_BYTES = 8 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the frame has at most so many rows and bytes, as written out; reads no more than one row beyond."""
    found = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")).first()
    return found["rows"] <= rows and found["size"] <= size


def _condition(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> Column:
    """Equal keys; nulls match nulls."""
    return reduce(Column.__and__, [left["`" + a.replace("`", "``") + "`"].eqNullSafe(right["`" + b.replace("`", "``") + "`"]) for a, b in keys])


def _aligned(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Keys of different types become text, as no value of one could equal one of the other else."""
    lk, rk = {f.name: f.dataType for f in left.schema}, {f.name: f.dataType for f in right.schema}
    for a, b in keys:
        x, y = lk[a], rk[b]
        if C.kind_of(x) != C.kind_of(y) and C.STR in (C.kind_of(x), C.kind_of(y)):
            left, right = left.withColumn(a, C.name(a).cast("string")), right.withColumn(b, C.name(b).cast("string"))
    return left, right


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], anchors: Sequence[str] = ("Join", "Left", "Right")) -> dict[str, DataFrame]:
    """``Join``: matching pairs; ``Left``, ``Right``: rows without a match, with their own fields only.

    A key of one name on both sides comes once, of two names twice; other names that clash get ``_right``. No keys: all
    pairs, and nothing is left over. Only the asked anchors are built."""
    if not keys:
        return {k: v for k, v in {"Join": left.crossJoin(_renamed(left, right, ())), "Left": left.where(F.lit(False)), "Right": right.where(F.lit(False))}.items() if k in anchors}
    left, right = _aligned(left, right, keys)
    same = [b for a, b in keys if a == b]
    out = {}
    if "Join" in anchors:
        other = _renamed(left, right, same)
        names = dict(zip(right.columns, other.columns, strict=True))
        joined = left.join(other, _condition(left, other, [(a, names[b]) for a, b in keys]), "inner")
        out["Join"] = joined.drop(*[other[f"`{names[b]}`"] for b in same])
    if "Left" in anchors:
        lost = right.select(*[C.name(b).alias(f"__r{i}") for i, (_, b) in enumerate(keys)])
        out["Left"] = left.join(lost, reduce(Column.__and__, [left[f"`{a}`"].eqNullSafe(lost[f"__r{i}"]) for i, (a, _) in enumerate(keys)]), "left_anti")
    if "Right" in anchors:
        lost = left.select(*[C.name(a).alias(f"__l{i}") for i, (a, _) in enumerate(keys)])
        out["Right"] = right.join(lost, reduce(Column.__and__, [right[f"`{b}`"].eqNullSafe(lost[f"__l{i}"]) for i, (_, b) in enumerate(keys)]), "left_anti")
    return out


def _renamed(left: DataFrame, right: DataFrame, same: Sequence[str]) -> DataFrame:
    taken = set(left.columns)
    names = []
    for c in right.columns:
        n = f"__key_{c}" if c in same else c
        while n in taken:
            n += "_right"
        taken.add(n)
        names.append(n)
    return right.toDF(*names)


def join_by_position(left: DataFrame, right: DataFrame, left_order: O.Order = (), right_order: O.Order = ()) -> dict[str, DataFrame]:
    """Rows side by side by number. ``Join`` is as long as the longer side, ``Left`` and ``Right`` are what one has more."""
    a = O.numbered(left, "__row", left_order)
    b = O.numbered(_renamed(left, right, ()), "__row", right_order)
    return {
        "Join": a.join(b, "__row", "full").drop("__row"),
        "Left": a.join(b.select("__row"), "__row", "left_anti").drop("__row"),
        "Right": O.numbered(right, "__row", right_order).join(a.select("__row"), "__row", "left_anti").drop("__row"),
    }


def join_multiple(frames: Sequence[DataFrame], keys: Sequence[str] | None = None, by_position: bool = False) -> DataFrame:
    """Full outer join of all frames, from the left, on the names they share; nulls match nulls."""
    out = frames[0]
    if by_position:
        for other in frames[1:]:
            out = join_by_position(out, other)["Join"]
        return out
    for other in frames[1:]:
        on = [c for c in (keys or out.columns) if c in other.columns and c in out.columns]
        if not on:
            raise ValueError("the frames share no field")
        marked = other.toDF(*[f"__b_{c}" if c in on else c + ("_right" if c in out.columns else "") for c in other.columns])
        joined = out.join(marked, reduce(Column.__and__, [C.name(c).eqNullSafe(C.name(f"__b_{c}")) for c in on]), "full")
        rest = [c for c in marked.columns if not c.startswith("__b_")]
        out = joined.select(*[F.coalesce(C.name(c), C.name(f"__b_{c}")).alias(c) if c in on else C.name(c) for c in out.columns], *[C.name(c) for c in rest])
    return out


def append_fields(targets: DataFrame, source: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every target row with every source row; this operator's meaning is the product. A source of at most ``rows`` rows and
    ``BROADCAST_BYTES`` is sent to the tasks, a larger one is left to the planner. Clashing names get ``_x`` and ``_y``."""
    clash = set(targets.columns) & set(source.columns)
    t = targets.toDF(*[f"{c}_x" if c in clash else c for c in targets.columns])
    s = source.toDF(*[f"{c}_y" if c in clash else c for c in source.columns])
    return t.crossJoin(F.broadcast(s) if small(s, rows) else s)


def union(frames: Sequence[DataFrame], by_name: bool = True, diagnostics: list | None = None) -> DataFrame | None:
    """All rows of all frames. By name: fields in the order they are first seen, missing ones null. By position: the names of
    the first; later frames may have fewer fields, not more. Fields of different types take a common one, else text."""
    if not frames:
        return None
    if not by_name:
        first = frames[0].columns
        if any(len(f.columns) > len(first) for f in frames):
            raise ValueError("an input has more fields than the first")
        frames = [f.toDF(*first[: len(f.columns)]) for f in frames]
    kinds: dict[str, list[T.DataType]] = {}
    for f in frames:
        for x in f.schema:
            kinds.setdefault(x.name, []).append(x.dataType)
    texts = set()
    for n, ts in kinds.items():
        if len({C.kind_of(t) for t in ts} - {C.NULL}) > 1:
            texts.add(n)
            if diagnostics is not None:
                diagnostics.append(("type_mismatch", f"{n} has several types and becomes text"))
    if texts:
        frames = [f.withColumns({n: C.name(n).cast("string") for n in texts if n in f.columns}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def find_replace(targets: DataFrame, lookup: DataFrame, field: str, find: str, replace: str | None = None, *, mode: str = "exact", append: Sequence[str] = ()) -> DataFrame:
    """Replace values of a field from a table, or append fields of the table's matching row.

    ``exact``: the whole value, by a join on the table reduced to one row per value. ``part``: every occurrence in the text,
    rule after rule, longer ones first, of equally long ones the smaller first; what a rule has put in is text for the next.
    Any number of rules: beyond ``EXPRESSIONS`` they are read in blocks, each an automaton that finds the rules that apply,
    and no text is shuffled; beyond ``SENT_BYTES`` they stay a frame (see ``_looked_up``), but for streams. Nulls and empty texts in
    the table match nothing."""
    pairs = lookup.where(C.name(find).isNotNull())
    if mode == "exact":
        picks = [replace] if replace else list(append)
        one = pairs.groupBy(C.name(find).cast("string").alias("__find")).agg(*[F.min_by(C.name(c), F.struct(*[C.name(x) for x in picks])).alias(f"__{c}") for c in picks])
        joined = targets.join(one, C.name(field).cast("string") == F.col("__find"), "left")
        if replace:
            new = F.when(F.col("__find").isNotNull(), C.name(f"__{replace}")).otherwise(C.name(field))
            return joined.withColumn(field, new).select(*[C.name(c) for c in targets.columns])
        return joined.select(*[C.name(c) for c in targets.columns], *[C.name(f"__{c}").alias(c if c not in targets.columns else f"{c}_right") for c in picks])
    given = pairs.select(C.name(find).cast("string").alias("a"), F.coalesce(C.name(replace).cast("string"), F.lit("")).alias("b")).where("a <> ''")
    if not targets.isStreaming:
        sizes = given.groupBy(F.octet_length("a").alias("length")).agg(F.count(F.lit(1)).alias("rules"), F.sum((F.octet_length("a") + F.octet_length("b")).cast("double")).alias("size")).collect()
        if sum(r["size"] for r in sizes) > SENT_BYTES:
            return _looked_up(targets, given, field, sum(r["rules"] for r in sizes), [r["length"] for r in sizes])
    rules = given.distinct()
    in_order = rules.orderBy(F.length("a").desc(), "a", "b")
    first = [(r["a"], r["b"]) for r in in_order.limit(EXPRESSIONS + 1).collect()]
    if len(first) <= EXPRESSIONS:
        if not first:
            return targets
        table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in first])
        return targets.withColumn(field, F.aggregate(table, C.name(field).cast("string"), lambda text, r: F.replace(text, r["a"], r["b"])))
    ship(targets.sparkSession)
    held, size, blocks = [], 0, []
    context = targets.sparkSession.sparkContext
    for r in in_order.toLocalIterator():
        held.append((r["a"], r["b"]))
        size += len(r["a"]) + len(r["b"])
        if size >= AUTOMATON_BYTES:
            blocks.append(context.broadcast(held))
            held, size = [], 0
    if held:
        blocks.append(context.broadcast(held))
    return targets.withColumn(field, _automata(blocks)(C.name(field).cast("string")))


def _measured(df: DataFrame) -> DataFrame:
    """A side that is sent if it was measured to be small, and never else: the planner's guesses of checkpoints are far too low."""
    return F.broadcast(df) if small(df) else df.hint("merge")


def _looked_up(targets: DataFrame, given: DataFrame, field: str, rules: int, lengths: Sequence[int]) -> DataFrame:
    """Replacements by rules (a, b) that stay a frame, with the same result.

    A filter of fixed size finds the pieces of the different texts that may be rules; those pieces are looked up by a join and
    replaced text by text. What a rule has put in may make pieces that were not looked up: these texts go on in another
    round. Texts that change are joined with the targets. Frames are read several times."""
    spark = targets.sparkSession
    ship(spark)
    bits = P.filter_bits(rules)
    marks = given.select("a").mapInArrow(P.marks(bits), "part bigint, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits"))
    sent = spark.sparkContext.broadcast(P.Filter({r["part"]: bytes(r["bits"]) for r in marks.collect()}, bits, lengths))
    texts = targets.select(C.name(field).cast("string").alias("origin")).where("origin <> ''").mapInArrow(P.find(sent), "origin string, asks array<string>").dropDuplicates(["origin"])
    none = F.array().cast("array<string>")
    state = texts.select(F.monotonically_increasing_id().alias("id"), "origin", F.col("origin").alias("text"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), none.alias("asked"), F.array().cast(P.RULES).alias("rules"), "asks")
    state, ready = cut(state), []
    while not state.isEmpty():
        asks = state.select("id", F.explode("asks").alias("a"))
        keys = asks.select("a").distinct()
        hits = cut(given.join(_measured(keys), "a").distinct())
        more = asks.join(_measured(hits), "a").groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("more"))
        known = F.concat("rules", F.coalesce("more", F.array().cast(P.RULES)))
        asked = state.join(more.hint("merge"), "id", "left").select("id", "origin", "text", "a", "b", F.concat("asked", "asks").alias("asked"), known.alias("rules"))
        state = cut(asked.mapInArrow(P.replaced(sent), P.STATE))
        ready.append(state.where("size(asks) = 0 and text <> origin").select(F.col("origin").alias("__find"), F.col("text").alias("__text")))
        state = state.where("size(asks) > 0")
    text = C.name(field).cast("string")
    if not ready:
        return targets.withColumn(field, text)
    new = reduce(DataFrame.unionAll, ready)
    joined = targets.join(_measured(new), text == F.col("__find"), "left")
    return joined.withColumn(field, F.coalesce("__text", text)).select(*[C.name(c) for c in targets.columns])


class Rules:
    """Replacements in order, each of all occurrences, as if one after the other; only those that occur cost time."""

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        import ahocorasick

        self.rules = rules
        self.found = ahocorasick.Automaton()
        for i, (a, _) in enumerate(rules):
            if a not in self.found:  # a second rule for a text finds nothing more, unless its own replacement brings it back
                self.found.add_word(a, [])
            self.found.get(a).append(i)
        self.found.make_automaton()

    def apply(self, text: str | None) -> str | None:
        done = -1
        while text:
            following = [i for _, same in self.found.iter(text) for i in same if i > done]
            if not following:
                break
            done = min(following)
            text = text.replace(*self.rules[done])
        return text


#: Automata a worker keeps; of more blocks each is made again for every batch of texts.
KEPT = 8


def _automata(blocks: list):  # noqa: ANN202
    """Block after block of the rules over a batch of texts."""
    made: dict[int, Rules] = {}

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        for i, sent in enumerate(blocks):
            rules = made.get(i) or Rules(sent.value)
            if len(blocks) <= KEPT:
                made[i] = rules
            texts = texts.map(rules.apply, na_action="ignore")
        return texts

    return replaced


def _texts(df: DataFrame, key: str, field: str) -> DataFrame:
    """(k, t): keys and their texts as ``fuzzy_match`` compares them, without nulls and blanks."""
    return df.select(C.name(key).alias("k"), F.lower(C.strip(C.name(field))).alias("t")).where("t is not null and t <> ''")


def _pieces(texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(band, gram, spot, at, id, n) of the texts (id, t, n) as the shorter and as the longer of two.

    Lengths are divided into bands. In the band of the shorter text its pieces are of one size and one more than the edits
    that the longest text it may be like allows, so one of them stands in that text, at most as many places away. The longer
    text has all its grams of that size in each of the few bands of its possible partners: rows in proportion to its length."""
    ratio = threshold**-0.5
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(ratio) + 1e-9).cast("int")
    power = lambda b: F.pow(F.lit(ratio), b)
    edits = F.floor(power(F.col("band") + 1) * ((1 - threshold) / threshold) + 1e-6).cast("int")
    size = F.greatest(F.floor(power(F.col("band")) / (F.col("d") + 1) - 1e-9), F.lit(1)).cast("int")
    width = 2 * F.col("d") + 1
    gram = lambda at: F.struct(at.alias("at"), F.substring(F.col("t"), at + 1, F.col("q")).alias("gram"))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("gram")))  # texts so short that all of them may be edited
    short = texts.withColumn("band", band(F.col("n"))).withColumn("d", edits).withColumn("q", size)
    own = F.when(F.col("n") < F.col("d") + 1, whole).otherwise(F.transform(F.sequence(F.lit(0), F.col("d")), lambda i: gram(i * F.col("q"))))
    short = short.select("band", F.explode(own).alias("g"), "d", "id", "n").select("band", "g.gram", F.floor(F.col("g.at") / width).cast("int").alias("spot"), "g.at", "id", "n")
    least = F.greatest(F.ceil(F.col("n") * threshold - 1e-9), F.lit(1)).cast("int")
    long = texts.withColumn("band", F.explode(F.sequence(band(least), band(F.col("n"))))).withColumn("d", edits).withColumn("q", size)
    grams = F.when(F.col("n") >= F.col("q"), F.transform(F.sequence(F.lit(0), F.col("n") - F.col("q")), gram)).otherwise(F.array().cast("array<struct<at: int, gram: string>>"))
    grams = F.when(power(F.col("band")) < F.col("d") + 1 + 1e-6, F.concat(whole, grams)).otherwise(grams)
    long = long.select("band", F.explode(grams).alias("g"), "d", "id", "n")
    at = F.col("g.at")
    spots = F.array_distinct(F.array(F.floor((at - F.col("d")) / width).cast("int"), F.floor((at + F.col("d")) / width).cast("int")))
    return short, long.select("band", "g.gram", F.explode(F.when(F.col("g.gram") == "", F.array(F.lit(0))).otherwise(spots)).alias("spot"), "g.at", "id", "n")


def _alike(texts: DataFrame, threshold: float) -> DataFrame:
    """(t1, t2, score) of different texts of the column t, each pair once."""
    sized = cut(texts.select("t").distinct().select(F.monotonically_increasing_id().alias("id"), "t", F.length("t").alias("n")))
    short, long = _pieces(sized, threshold)
    short = short.select("band", "gram", "spot", F.col("at").alias("at1"), F.col("id").alias("a"), F.col("n").alias("m"))
    most = F.floor(F.col("n") * (1 - threshold) + 1e-9)
    near = (F.col("gram") == "") | (F.abs(F.col("at") - F.col("at1")) <= most)
    pairs = short.join(long, ["band", "gram", "spot"]).where((F.col("a") != F.col("id")) & (F.col("m") <= F.col("n")) & (F.col("n") - F.col("m") <= most) & near)
    # only ids travel with the candidates
    pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    named = pairs.join(sized.select(F.col("id").alias("a"), F.col("t").alias("t1"), F.col("n").alias("n1")), "a").join(sized.select(F.col("id").alias("b"), F.col("t").alias("t2"), F.col("n").alias("n2")), "b")
    score = 1 - F.levenshtein("t1", "t2") / F.greatest("n1", "n2")
    return named.select(F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2"), score.alias("score")).where(F.col("score") >= threshold)


def fuzzy_match(df: DataFrame, key: str, field: str, *, threshold: float = 0.8) -> DataFrame:
    """Pairs (id_left, id_right, score) of different texts that are alike: score is 1 - edit distance / longer length.

    Rows are blocked: texts at distance d share one of d + 1 pieces at nearly the same place, so candidates come from an
    equi-join on pieces of texts of like length and no pair at or above the threshold is lost (see ``_pieces``). Equal texts are one
    text here, named by the smallest of their keys: ``fuzzy_pairs`` has all rows, ``fuzzy_members`` who belongs to which text.
    """
    texts = _texts(df, key, field).groupBy("t").agg(F.min("k").alias("k"))
    pairs = _alike(texts, threshold).join(texts.toDF("t1", "k1"), "t1").join(texts.toDF("t2", "k2"), "t2").where("k1 <> k2")
    return pairs.select(F.least("k1", "k2").alias("id_left"), F.greatest("k1", "k2").alias("id_right"), "score")


def fuzzy_pairs(df: DataFrame, key: str, field: str, *, threshold: float = 0.8) -> DataFrame:
    """(id_left, id_right, score): every pair of different keys whose texts are alike, equal texts with score 1. A key with
    several texts counts with the best of them. Only different texts are compared, but the result is as large as the pairs
    are: a text of n keys makes n * (n - 1) / 2 of them. ``fuzzy_members`` says the same in one row a key and text."""
    members = _texts(df, key, field).distinct()
    left, right = members.toDF("k1", "t1"), members.toDF("k2", "t2")
    equal = left.join(right, F.col("t1") == F.col("t2")).where("k1 < k2").select("k1", "k2", F.lit(1.0).alias("score"))
    alike = _alike(members, threshold).join(left, "t1").join(right, "t2").where("k1 <> k2").select("k1", "k2", "score")
    pairs = equal.unionByName(alike).groupBy(F.least("k1", "k2").alias("id_left"), F.greatest("k1", "k2").alias("id_right"))
    return pairs.agg(F.max("score").alias("score"))


def fuzzy_members(df: DataFrame, key: str, field: str, *, threshold: float = 0.8) -> DataFrame:
    """(member, representative, members, links): every key with each of its texts, the smallest key of the equal texts, how many
    keys have that text, and how many other texts are alike. A class of copies is a result also where no other text is alike."""
    members = _texts(df, key, field).distinct()
    classes = members.groupBy("t").agg(F.min("k").alias("representative"), F.count(F.lit(1)).alias("members"))
    alike = _alike(members, threshold)
    links = alike.select("t1").union(alike.select("t2")).toDF("t").groupBy("t").agg(F.count(F.lit(1)).alias("links"))
    joined = members.join(classes, "t").join(links, "t", "left")
    return joined.select(F.col("k").alias("member"), "representative", "members", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def make_group(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(member, group): connected members, the group named by its smallest member.

    Large-star and small-star rounds: every round links members to smaller ones and at least halves the distances, with the
    edges checkpointed; the hub of a large group is split by map-side combine. Nulls link nothing."""
    e = edges.select(C.name(a).alias("u"), C.name(b).alias("v")).where("u is not null and v is not null")
    members = e.select("u").union(e.select("v")).distinct()
    links = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # large star: neighbours above u go to the least neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        floor = low.groupBy("u").agg(F.min("v").alias("m"))
        to_floor = low.join(floor, "u")
        new = to_floor.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        new = cut(new)
        if links.exceptAll(new).isEmpty() and new.exceptAll(links).isEmpty():
            break
        links = new
    return members.join(links, "u", "left").select(F.col("u").alias("member"), F.coalesce("v", "u").alias("group"))
