"""Merged periods and gaps of intervals per entity, through compressed run bitmaps.

Time is cut into units and shards of 60 units. An interval becomes a word of
60 bits for the shards of its two ends and one fill, a count of full words, for
all shards between them, so that its length doesn't matter. Words of an entity
and shard are united by bit_or (combined before the shuffle), and set runs and
clear runs are read back from words and fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD = 60


def run_bitmaps(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, shard, words, bits) of intervals with whole-number ends, both included.

    words is 1 for a word and the number of full words for a fill that starts
    at the shard. Rows with a null end or with end < start are left out.
    """
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    rows = intervals.where(s.isNotNull() & e.isNotNull() & (s <= e)).select(F.col(entity), s.alias("_s"), e.alias("_e"))
    shard_of = lambda c: F.floor(c / SHARD).cast("long")
    rows = rows.withColumn("_a", shard_of(F.col("_s"))).withColumn("_b", shard_of(F.col("_e")))
    a, b, last = F.col("_a"), F.col("_b"), F.lit(SHARD - 1).cast("int")
    lo, hi = (F.col("_s") - a * SHARD).cast("int"), (F.col("_e") - b * SHARD).cast("int")
    bits = lambda low, high: F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), high - low + 1) - 1, low)
    word = lambda shard, low, high: F.struct(shard.alias("shard"), F.lit(1).cast("long").alias("words"), bits(low, high).alias("bits"))
    fill = F.struct((a + 1).alias("shard"), (b - a - 1).alias("words"), F.lit((1 << SHARD) - 1).cast("long").alias("bits"))
    ends = F.when(a == b, F.array(word(a, lo, hi))).otherwise(F.array(word(a, lo, last), word(b, F.lit(0), hi)))
    parts = F.when(b - a > 1, F.concat(ends, F.array(fill))).otherwise(ends)
    return rows.select(entity, F.inline(parts)).groupBy(entity, "shard", "words").agg(F.bit_or("bits").alias("bits"))


def _set_bits(word: Column) -> Column:
    at = F.sequence(F.lit(0), F.lit(SHARD - 1))
    return F.filter(at, lambda i: F.call_function("shiftright", word, i).bitwiseAND(F.lit(1).cast("long")) == 1)


def periods_and_gaps(bitmaps: DataFrame, entity: str) -> DataFrame:
    """(entity, kind, from_unit, to_unit): maximal set runs as period, clear runs between them as gap."""
    bits = F.col("bits")
    starts = bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", bits, F.lit(1))))
    ends = bits.bitwiseAND(F.bitwise_not(F.call_function("shiftrightunsigned", bits, F.lit(1))))
    runs = bitmaps.select(entity, "shard", "words", F.explode(F.arrays_zip(_set_bits(starts).alias("a"), _set_bits(ends).alias("b"))).alias("r")).select(
        entity, (F.col("shard") * SHARD + F.col("r.a")).alias("from_unit"), ((F.col("shard") + F.col("words") - 1) * SHARD + F.col("r.b")).alias("to_unit")
    )
    w = Window.partitionBy(entity).orderBy("from_unit", "to_unit")
    reached = F.max("to_unit").over(w.rowsBetween(Window.unboundedPreceding, -1))  # fills may lie over words
    fresh = F.coalesce((F.col("from_unit") > reached + 1).cast("int"), F.lit(1))
    merged = (
        runs.withColumn("_new", fresh)
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(entity, "_run")
        .agg(F.min("from_unit").alias("from_unit"), F.max("to_unit").alias("to_unit"))
    )
    rows = merged.withColumn("_next", F.lead("from_unit").over(Window.partitionBy(entity).orderBy("from_unit")))
    period = F.struct(F.lit("period").alias("kind"), "from_unit", "to_unit")
    gap = F.struct(F.lit("gap").alias("kind"), (F.col("to_unit") + 1).alias("from_unit"), (F.col("_next") - 1).alias("to_unit"))
    both = F.when(F.col("_next").isNull(), F.array(period)).otherwise(F.array(period, gap))
    return rows.select(entity, F.explode(both).alias("x")).select(entity, "x.kind", "x.from_unit", "x.to_unit")


def month_index(normal_form: Column) -> Column:
    """Months since year 0 of a normal form; a bare year means June."""
    year = F.try_element_at(F.split(normal_form, "-"), F.lit(1)).cast("long")
    month = F.when(F.length(normal_form) == 4, F.lit(6)).otherwise(F.substring(normal_form, 6, 2).cast("long"))
    return year * 12 + month - 1


def month_text(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("long"), (index % 12 + 1).cast("long"))


def employment_periods(experience: DataFrame, contact: DataFrame, present: str = "2026-08") -> DataFrame:
    """(doc_id, kind, from_month, to_month) of the jobs of each résumé.

    Of each (doc_id, pos) the row received last counts, then the larger row_id.
    An end that states a date holds; a word for the present means `present`; a
    blank or unreadable end means `present` if is_current is true, else the
    row is left out, as are rows without a start or ending before it.
    """
    from quern.operators.timestamps import contact_settings, is_present_word, normal_form

    wanted = ["row_id", "doc_id", "pos", "start_date", "end_date", "is_current", "received_at"]
    kept = (
        experience.select(*wanted)
        .groupBy("doc_id", "pos")
        .agg(F.max_by(F.struct("start_date", "end_date", "is_current"), F.struct("received_at", "row_id")).alias("j"))
        .select("doc_id", "j.*")
        .where(F.col("start_date").rlike("[0-9０-９]"))
        .join(contact_settings(contact), "doc_id", "left")
    )
    now = month_index(F.lit(present))
    end_form = normal_form(F.col("end_date"), F.col("locale"), F.col("time_zone"))
    start_form = normal_form(F.col("start_date"), F.col("locale"), F.col("time_zone"))
    forms = kept.select("doc_id", "end_date", "is_current", start_form.alias("_sf"), end_form.alias("_ef"))
    end = (
        F.when(F.col("_ef").isNotNull(), month_index(F.col("_ef")))
        .when(is_present_word(F.col("end_date")) | F.coalesce(F.col("is_current"), F.lit(False)), now)
    )
    months = forms.select("doc_id", month_index(F.col("_sf")).alias("s"), end.alias("e"))
    found = periods_and_gaps(run_bitmaps(months, "doc_id", "s", "e"), "doc_id")
    return found.select("doc_id", "kind", month_text(F.col("from_unit")).alias("from_month"), month_text(F.col("to_unit")).alias("to_month"))
