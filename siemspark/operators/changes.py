"""Versioned changes of objects: batches of patches, each accepted only on the version it names.

Patches of one object depend on each other: one is accepted if it names the current version and fits the
current state, and then both change.  An object may still have any share of all patches, because
acceptance needs little of both.  ``Rules.states`` lists the states that it can tell apart and ``Rules.kinds`` the
patches, so a patch is a row of a small table from state to next state, and a stretch of patches a table from (version, state)
on entry to (version, state) on leaving:

1. Patches are dealt by ranges of (object, order) into chunks.  Most objects lie in one.
2. For objects in several chunks each chunk lists its table, for entries that the chunks before can produce.
3. Each entry points to the next chunk that moves its result on.  The entries that the stored state leads to are
   marked by doubling these pointers, in as many rounds as the number of chunks has binary digits.
4. Now every chunk knows where it begins.  It runs through its patches once and keeps the accepted ones.
5. The full state before an accepted patch is the last value written to each field: in its chunk, in the chunks
   before (a scan over one row per chunk), or in the stored object.

Streams of rows pass through Python in steps 2 and 4, whole numbers only; the rest are columns.

Both sides of the joins grow with the objects and patches, and their written columns pack so well that their files look small
enough to be sent to every task; ``MERGE`` keeps them from passing through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siemspark.operators.ordered import CHUNK, dealt_in_chunks
from siemspark.session import cut_lineage

MERGE = "merge"


@dataclass(frozen=True)
class Rules:
    """How one kind of object changes.

    ``fields`` are the state columns besides ``version``; ``check(s, p)`` tells whether patch ``p`` fits state
    ``s``; ``change(s, p)`` gives the new values; ``event(s, n, p)`` gives (event type, action, reason) for audit.

    ``kinds`` says what ``check`` and the states' ``change`` look at in a patch: for each field some example values and a
    function that gives the place of the example a value is like.  All other fields and differences do not matter to them.
    ``states`` are examples of all states that ``check`` tells apart, as values of some fields; ``index(s)`` is the
    place of a state's example, null if no patch ever fits it.  ``writes(s, p)`` gives, for each field that no example holds as it is,
    a struct of the value that an accepted patch writes, or null if it leaves the field; it may read the fields of ``s``
    in ``known``, which examples do hold as they are.
    """

    kind: str
    fields: tuple[str, ...]
    patch_fields: tuple[str, ...]
    check: Callable[[Column, Column], Column]
    change: Callable[[Column, Column], dict[str, Column]]
    event: Callable[[Column, dict[str, Column], Column], tuple[Column, Column, Column]]
    kinds: dict[str, tuple[list, Callable[[Column], Column]]]
    states: tuple[dict[str, str], ...]
    index: Callable[[dict[str, Column]], Column]
    known: tuple[str, ...]
    writes: Callable[[dict[str, Column], Column], dict[str, Column]]


def _kind(rules: Rules, p: Column) -> Column:
    """The number of a patch's kind: the places of its fields' examples as digits."""
    number, weight = F.lit(0), 1
    for field, (examples, place) in rules.kinds.items():
        number = number + place(p[field]) * weight
        weight *= len(examples)
    return number.cast("int")


def _moves(spark, rules: Rules, types: dict, patch_types: dict) -> list[list[int]]:
    """For each kind of patch and each example state the place of the next one, -1 where the patch does not fit.

    The last state fits none.  The table is as large as the rules make it, whatever the data.
    """
    number, fields, total = F.col("id"), {}, 1
    for field, (examples, _) in rules.kinds.items():
        values = F.array(*[F.lit(e).cast(patch_types[field]) for e in examples])
        fields[field] = F.element_at(values, (F.floor(number / total) % len(examples) + 1).cast("int"))
        total *= len(examples)
    patch = F.struct(*[fields.get(f, F.lit(None).cast(patch_types[f])).alias(f) for f in rules.patch_fields])
    states = F.array(*[F.struct(*[F.lit(s.get(f)).cast(types[f]).alias(f) for f in rules.fields]) for s in rules.states])
    pairs = (spark.range(total).select("id", patch.alias("_p"), states.alias("_states"))
             .select("id", "_p", F.posexplode("_states").alias("_q", "_s")))
    fits = F.coalesce(rules.check(F.col("_s"), F.col("_p")), F.lit(False))
    found = pairs.select("id", "_q", F.when(fits, _place(rules, rules.change(F.col("_s"), F.col("_p")))).otherwise(-1)
                         .alias("to")).toArrow()
    table = [[-1] * (len(rules.states) + 1) for _ in range(total)]
    for kind, state, to in zip(*(found[c].to_pylist() for c in ("id", "_q", "to")), strict=True):
        table[kind][state] = to
    return table


def _place(rules: Rules, s: dict[str, Column]) -> Column:
    return F.coalesce(rules.index(s).cast("int"), F.lit(len(rules.states)))


def apply_changes(objects: DataFrame, patches: DataFrame, rules: Rules, key: Sequence[str],
                  order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(new states, audit rows) after a batch of versioned patches.

    Patches of one object are taken in ``order``; one is accepted when it names the current version and passes the
    checks, and then the version goes up by one.  ``objects`` has ``key``, ``version`` and the state fields, an
    object once; ``patches`` has ``key``, ``order``, ``expected_version`` and the patch fields.  Patches of unknown
    objects are ignored.
    """
    key, order = list(key), list(order)
    places = [f"_o{i}" for i in range(len(order))]
    types = {f: objects.schema[f].dataType for f in rules.fields}
    base = objects.select(*key, F.col("version").cast("int").alias("_v"),
                          _place(rules, {f: F.col(f) for f in rules.fields}).alias("_q"),
                          F.struct(*rules.fields).alias("_s"))
    rows = (patches.where(F.col("expected_version") >= 1)
            .select(*key, *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)],
                    F.col("expected_version").cast("int").alias("_e"),
                    F.struct(*rules.patch_fields).alias("_p")))
    moves = _moves(objects.sparkSession, rules, types, {f: patches.schema[f].dataType for f in rules.patch_fields})
    rows, chunks = dealt_in_chunks(rows, key, places, "patches")
    rows = rows.withColumn("_t", _kind(rules, F.col("_p")))

    if chunks == 1:
        spans = base.withColumn(CHUNK, F.lit(0))
        enter = spans.select(*key, CHUNK, "_v", "_q")
    else:
        spans = rows.select(*key, CHUNK).distinct().join(base.hint(MERGE), key)
        spans = cut_lineage(spans.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))), "spans")
        most = spans.agg(F.max("_n").alias("n")).first()["n"] or 0
        enter = spans.where(F.col("_n") == 1).select(*key, CHUNK, "_v", "_q")
        if most > 1:
            enter = enter.unionByName(_entries_reached(rows, spans.where(F.col("_n") > 1), moves, key, places, most))

    accepted = cut_lineage(_accepted(rows, enter, moves, key, places), "accepted")
    told = _with_state(accepted, spans, rules, key)
    new = rules.change(F.col("_s"), F.col("_p"))
    last = told.groupBy(*key).agg(F.max_by(
        F.struct((F.col("_v") + 1).alias("version"), *[new[f].cast(types[f]).alias(f) for f in rules.fields]),
        "_v").alias("_l"))
    done = base.join(last.hint(MERGE), key, "left")
    state = done.select(*key, F.coalesce("_l.version", "_v").alias("version"), *[
        F.when(F.col("_l").isNull(), F.col("_s")[f]).otherwise(F.col("_l")[f]).alias(f) for f in rules.fields])

    kind, action, reason = rules.event(F.col("_s"), new, F.col("_p"))
    audit = told.select(*key, kind.alias("event_type"), action.alias("action"), reason.alias("reason"),
                        F.col("_v").alias("before_version"), (F.col("_v") + 1).alias("after_version"),
                        F.col("_s")["status"].alias("before_status"), new["status"].alias("after_status"))
    return state, audit


# --- which patches are accepted --------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch], names: list[str]):
    """(batch, values of ``names`` of each row)."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        yield batch, list(zip(*columns, strict=True))


def _in_order(rows: DataFrame, key: list[str], places: list[str]) -> DataFrame:
    """The rows of an object in a chunk together and in order."""
    return rows.repartition(CHUNK, *key).sortWithinPartitions(CHUNK, *key, *places)


def _accepted(rows: DataFrame, enter: DataFrame, table: list[list[int]], key: list[str], places: list[str]) -> DataFrame:
    """The accepted patches with the version and state before them."""
    on = [*key, CHUNK]
    begun = _in_order(rows.join(enter.hint(MERGE), on), key, places)

    def run(batches):
        at, version, state = None, 0, 0
        for batch, found in _runs(batches, [*on, "_v", "_q", "_e", "_t"]):
            keep, versions, before = [], [], []
            for *here, v, q, expected, kind in found:
                if here != at:
                    at, version, state = here, v, q
                taken = expected == version and table[kind][state] >= 0
                keep.append(taken)
                if taken:
                    versions.append(version)
                    before.append(state)
                    version, state = version + 1, table[kind][state]
            part = batch.filter(pa.array(keep, pa.bool_())).select([*on, "_p"])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(versions, pa.int32()), pa.array(before, pa.int32())],
                                             names=[*on, "_p", "_v", "_q"])

    schema = begun.select(*on, "_p", F.col("_v").cast("int"), F.col("_q").cast("int")).schema
    return begun.mapInArrow(run, schema)


def _entries_reached(rows: DataFrame, spans: DataFrame, moves: list[list[int]], key: list[str], places: list[str],
                     most: int) -> DataFrame:
    """(key, chunk, version, state) with which objects of several chunks enter the chunks that accept something."""
    wide = rows.join(spans.select(*key, CHUNK).hint(MERGE), [*key, CHUNK], "left_semi").select(*key, CHUNK, *places, "_e", "_t")
    # An entry can be met with the stored version, or one above a version that an earlier chunk names.
    named = (wide.groupBy(*key, (F.col("_e") + 1).alias("_v")).agg(F.min(CHUNK).alias("_from"))
             .unionByName(spans.select(*key, "_v").distinct().withColumn("_from", F.lit(-1)))
             .groupBy(*key, "_v").agg(F.min("_from").alias("_from")))
    entries = _tables(wide, moves, key, places).join(named.hint(MERGE), [*key, "_v"])
    entries = entries.where(F.col("_from") < F.col(CHUNK)).drop("_from")
    entries = cut_lineage(entries.withColumn("_id", F.monotonically_increasing_id()), "entries")

    # Where a result is looked up next: the first later chunk with an entry for it.
    ask = entries.select(*key, F.col("_v2").alias("_v"), F.col("_q2").alias("_q"), CHUNK, F.col("_id").alias("_asks"),
                         F.lit(None).cast("long").alias("_id"))
    ask = ask.unionByName(spans.select(*key, "_v", "_q", F.lit(-1).alias(CHUNK), F.lit(-1).cast("long").alias("_asks"),
                                       F.lit(None).cast("long").alias("_id")).distinct())
    have = entries.select(*key, "_v", "_q", CHUNK, F.lit(None).cast("long").alias("_asks"), "_id")
    # Questions stand before the entries of their own chunk, so they see those of later chunks only.
    later = (Window.partitionBy(*key, "_v", "_q").orderBy(F.desc(CHUNK), F.col("_id").isNotNull())
             .rowsBetween(Window.unboundedPreceding, -1))
    found = (ask.unionByName(have).withColumn("_to", F.last("_id", ignorenulls=True).over(later))
             .where(F.col("_asks").isNotNull() & F.col("_to").isNotNull()))
    links = cut_lineage(found.select("_asks", "_to"), "links")
    reached = links.where(F.col("_asks") == -1).select(F.col("_to").alias("_id"))
    jump = links.where(F.col("_asks") >= 0)
    for _ in range(most.bit_length()):
        ahead = reached.join(jump.hint(MERGE), reached["_id"] == jump["_asks"]).select(F.col("_to").alias("_id"))
        reached = cut_lineage(reached.unionByName(ahead).distinct(), "reached")
        far = jump.select(F.col("_asks").alias("_mid"), F.col("_to").alias("_far"))
        jump = cut_lineage(jump.join(far.hint(MERGE), jump["_to"] == far["_mid"]).select("_asks", F.col("_far").alias("_to")), "jump")
    return entries.join(reached.hint(MERGE), "_id", "left_semi").select(*key, CHUNK, "_v", "_q")


def _tables(rows: DataFrame, table: list[list[int]], key: list[str], places: list[str]) -> DataFrame:
    """(key, chunk, version, state, version after, state after) for every entry that a chunk moves."""
    on = [*key, CHUNK]

    def moved(run):
        """``run``: (expected version, moves) in order.  Entries that meet go on together."""
        begun, here = set(), {}  # (version, state) -> entries that are there now
        for expected, kind in run:
            arrived = []
            for state, after in enumerate(table[kind]):
                if after < 0:
                    continue
                place = expected, state
                group = here.pop(place, [])
                if place not in begun:
                    begun.add(place)
                    group.append(place)
                if group:
                    arrived.append(((expected + 1, after), group))
            for place, group in arrived:
                other = here.get(place)
                if other is None:
                    here[place] = group
                elif len(other) < len(group):
                    group.extend(other)
                    here[place] = group
                else:
                    other.extend(group)
        return [(*entry, *place) for place, group in here.items() for entry in group]

    schema = rows.select(*on, *[F.lit(0).alias(c) for c in ("_v", "_q", "_v2", "_q2")]).schema

    def run(batches):
        at, held, kinds = None, [], None

        def out():
            found = moved(held)
            values = [[x] * len(found) for x in at] + [[f[i] for f in found] for i in range(4)]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, [*kinds, *[pa.int32()] * 4], strict=True)], names=schema.names)

        for batch, found in _runs(batches, [*on, "_e", "_t"]):
            kinds = kinds or [batch.schema.field(n).type for n in on]
            for *here, expected, kind in found:
                if here != at:
                    if held:
                        yield out()
                    at, held = here, []
                held.append((expected, kind))
        if held:
            yield out()

    return _in_order(rows, key, places).mapInArrow(run, schema)


# --- the state before an accepted patch ------------------------------------

def _with_state(accepted: DataFrame, spans: DataFrame, rules: Rules, key: list[str]) -> DataFrame:
    """Accepted patches with the whole state before them, ``_s``."""
    example = {f: F.element_at(F.array(*[F.lit(s.get(f)) for s in rules.states]), F.col("_q") + 1) for f in rules.known}
    rows = accepted.select("*", *[v.alias(f"_k_{f}") for f, v in example.items()])
    writes = rules.writes({f: F.col(f"_k_{f}") for f in rules.known}, F.col("_p"))
    rows = rows.select("*", *[w.alias(f"_w_{f}") for f, w in writes.items()])
    last = [F.max_by(f"_w_{f}", F.when(F.col(f"_w_{f}").isNotNull(), F.col("_v"))).alias(f"_b_{f}") for f in writes]
    summary = rows.groupBy(*key, CHUNK).agg(*last, F.max("_v").alias("_top"))
    before = Window.partitionBy(*key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*key, CHUNK, *[F.last(f"_b_{f}", ignorenulls=True).over(before).alias(f"_b_{f}") for f in writes])
    carry = carry.join(spans.select(*key, CHUNK, F.col("_s").alias("_first")).hint(MERGE), [*key, CHUNK])
    inside = Window.partitionBy(*key, CHUNK).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    for f in writes:
        rows = rows.withColumn(f"_i_{f}", F.last(f"_w_{f}", ignorenulls=True).over(inside))
    rows = rows.join(carry.hint(MERGE), [*key, CHUNK])

    def value(f):
        if f not in writes:
            return F.col(f"_k_{f}")
        inside, behind = F.col(f"_i_{f}"), F.col(f"_b_{f}")
        return (F.when(inside.isNotNull(), inside["value"]).when(behind.isNotNull(), behind["value"])
                .otherwise(F.col("_first")[f]))

    return rows.select(*key, CHUNK, "_v", "_p", F.struct(*[value(f).alias(f) for f in rules.fields]).alias("_s"))


def written(value: Column, when: Column) -> Column:
    """A write of ``value`` (which may be null), or null where ``when`` does not hold."""
    return F.when(when, F.struct(value.alias("value")))


def one_of(values: Sequence) -> tuple[list, Callable[[Column], Column]]:
    """A field whose values matter: null, each of ``values``, and any other."""
    values = list(values)

    def place(c: Column) -> Column:
        found = F.array_position(F.lit(values), c)
        return F.when(c.isNull(), 0).otherwise(F.when(found == 0, len(values) + 1).otherwise(found))

    return [None, *values, "?"], place


def texts(good: Callable[[Column], Column], yes: str, no: str) -> tuple[list, Callable[[Column], Column]]:
    """A field of which only matters whether it is null, good or not."""
    return [None, yes, no], lambda c: F.when(c.isNull(), 0).when(good(c), 1).otherwise(2)
