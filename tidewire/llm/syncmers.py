"""Document fingerprints of closed syncmers, in DataFrame functions only.

A text is read as units: words, and the characters of words of over LONG_WORD characters (so texts without spaces have
units too). Units are hashed; a run of K units is a closed syncmer if the least of its hashes stands at its first or last
unit. Whether a run is chosen depends on the run alone, so the same passage gives the same anchors in any text. A
fingerprint is the SKETCH smallest hashes of the anchors, each with the place where it first stands. Two fingerprints are
matched by position: common hashes count only where they lie in one alignment, that is where their places differ
by nearly the same offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let

#: Units in an anchor, hashes in a fingerprint, characters of the longest word that is one unit.
K, SKETCH, LONG_WORD = 6, 64, 24
#: Offsets of matched anchors that belong to one alignment differ by so many units at most.
BAND = 64
#: Bits of an entry that hold the place; a later place is held as the last one. The other 36 hold the hash.
PLACE_BITS = 27
_WHITE = r"\x20\x09-\x0D"
UNIT = rf"(?<![^{_WHITE}])[^{_WHITE}]{{1,{LONG_WORD}}}(?![^{_WHITE}])|[^{_WHITE}]"


def unit_hashes(text: Column) -> Column:
    """XXH64 of each unit in order. Splitting is the faster way where no word is long; the units are the same."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    units = F.when(F.regexp_like(text, F.lit(f"[^{_WHITE}]{{{LONG_WORD + 1}}}")), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))).otherwise(words)
    return F.transform(units, lambda w: F.xxhash64(w))


def _closed(h: Column, k: int) -> Column:
    """Where closed syncmers start, from 1; if there is none, where the run with the least hash starts; a shorter text: 1, an empty one: none."""
    least_inside = lambda i: F.array_min(F.slice(h, i + 1, F.lit(k - 2)))
    runs = F.sequence(F.lit(1), F.size(h) - (k - 1))
    found = F.filter(runs, lambda i: least_inside(i) >= F.least(F.element_at(h, i), F.element_at(h, i + (k - 1))))
    first = F.array(F.array_min(F.transform(runs, lambda i: F.struct(F.xxhash64(F.slice(h, i, F.lit(k))).alias("h"), i.alias("i"))))["i"])
    some = let(found, lambda at: F.when(F.size(at) > 0, at).otherwise(first))
    return F.when(F.size(h) >= k, some).when(F.size(h) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))


def anchors(text: Column, k: int = K) -> Column:
    """array<struct<unit int, hash long>>: where each anchor starts (unit number from 0) and its hash.

    Every text with a unit has an anchor: one of fewer than k units is its own anchor, and where no run is a closed syncmer
    the run with the least hash stands in.
    """
    entry = lambda h: lambda i: F.struct((i - 1).alias("unit"), F.xxhash64(F.slice(h, i, F.lit(k))).alias("hash"))
    return let(unit_hashes(text), lambda h: F.transform(_closed(h, k), entry(h)))


def sketch(text: Column, k: int = K, size: int = SKETCH) -> Column:
    """The anchors of least hash: array<long>, ascending; an entry is 36 bits of the hash above the first place (PLACE_BITS)."""
    last = (1 << PLACE_BITS) - 1

    def entry(h: Column):
        high = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(h, i, F.lit(k))), 28), PLACE_BITS)
        return lambda i: high(i).bitwiseOR(F.least(i - 1, F.lit(last)).cast("long"))

    first_of_hash = lambda s: F.filter(s, lambda x, i: (i == 0) | (_hash(x) != _hash(F.element_at(s, F.greatest(i, F.lit(1))))))
    return let(unit_hashes(text), lambda h: F.slice(let(F.array_sort(F.transform(_closed(h, k), entry(h))), first_of_hash), 1, size))


def _hash(entry: Column) -> Column:
    return F.shiftright(entry, PLACE_BITS)


def as_text(fp: Column) -> Column:
    """16 hexadecimal digits for each entry."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, size: int = SKETCH, band: int = BAND) -> Column:
    """0 to 1: the anchors matched in the best alignment, as a share of the size least hashes of both fingerprints.

    Only hashes among those least ones count, so it estimates a share of common anchors. An alignment holds the matches whose
    offset is within band above one of the offsets. a and b are columns that hold sketches. Two texts without units are alike (1).
    """
    hashes = lambda fp: F.transform(fp, _hash)
    last = (1 << PLACE_BITS) - 1
    place = lambda fp: lambda at: F.element_at(fp, at.cast("int")).bitwiseAND(F.lit(last))

    def matched(x: Column, y: Column) -> Column:
        both = F.slice(F.array_sort(F.array_union(x, y)), 1, size)
        common = F.array_intersect(both, F.array_intersect(x, y))
        offsets = F.transform(common, lambda v: place(a)(F.array_position(x, v)) - place(b)(F.array_position(y, v)))
        most = let(offsets, lambda o: F.array_max(F.transform(o, lambda low: F.size(F.filter(o, lambda v: (v >= low) & (v <= low + band))))))
        return F.coalesce(most, F.lit(0)) / F.size(both)

    alike = let(F.struct(hashes(a).alias("x"), hashes(b).alias("y")), lambda s: matched(s["x"], s["y"]))
    # most pairs have nothing in common; that is seen at once
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).when(~F.arrays_overlap(hashes(a), hashes(b)), F.lit(0.0)).otherwise(alike)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, anchors) of every whole text. A null or empty text has no anchor. Equal texts have equal anchors; an empty table gives an empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), anchors(F.coalesce(F.col(text_col), F.lit(""))).alias("anchors"))


def with_next(rows: DataFrame, payload: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rows plus __next: a struct of the payload columns of the next row by descending id; after the last one, of the first.

    Null ids come last. Rows of one id are ordered by their text's hash and then the text, so reruns agree however rows
    are dealt out; rows that are equal in both stand side by side. Rows are dealt out once, by ranges of (id, hash), as many as
    shuffle partitions, so neither null nor repeated ids fill one task unless their texts are equal too. Each range also gets
    a copy of the row that follows its last one: one row for each range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ascending order of these three is the order above; ~id turns the order of ids around without overflow
    key = F.struct(F.col(id_col).isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit(0)).alias("down"), F.xxhash64(F.col(text_col)).alias("tie"))
    narrow = rows.select(key.alias("key")).select("key.*").repartitionByRange(n, "none", "down", "tie")
    heads = narrow.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("none", "down", "tie")).alias("first")).collect()
    cuts = sorted((tuple(r["first"]) for r in heads))
    if not cuts:
        return rows.withColumn("__next", F.struct(*payload)).limit(0)
    lit = lambda c: F.struct(F.lit(c[0]).alias("none"), F.lit(c[1]).cast("long").alias("down"), F.lit(c[2]).cast("long").alias("tie"))
    table = F.array(*[lit(c) for c in cuts])
    dealt = rows.withColumn("__key", key).withColumn("__range", F.size(F.filter(table, lambda c: c <= F.col("__key"))) - 1)
    firsts = dealt.where(F.exists(table, lambda c: c == F.col("__key"))).groupBy("__range").agg(F.min(F.struct(F.col(text_col).alias("order"), F.struct(*payload).alias("held"))).alias("row"))
    guest = firsts.select(*[F.col(f"row.held.{c}").alias(c) if c in payload else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.lit(None).cast(dealt.schema["__key"].dataType).alias("__key"), F.pmod(F.col("__range") - 1, F.lit(len(cuts))).alias("__range"), F.lit(1).alias("__guest"))
    both = dealt.withColumn("__guest", F.lit(0)).unionByName(guest)
    order = Window.partitionBy("__range").orderBy("__guest", "__key", text_col)
    return both.withColumn("__next", F.lead(F.struct(*payload)).over(order)).where("__guest = 0").drop("__range", "__guest", "__key")


def op5_fingerprints(docs: DataFrame) -> DataFrame:
    """The rows of query op5: each text and its edited form, whose last half is replaced by the head of the next document.

    A null text is empty: no anchor, likeness 1 to another empty one and 0 to any other. Null ids come last and repeated ids
    are ordered by text (with_next), so the result doesn't depend on how rows are dealt out. A single row is its
    own next one. Other columns, whatever their names, are left out. An empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("fp", sketch(F.col("text")))
    rows = with_next(rows, ["text", "fp"])
    half = F.floor(F.col("n_chars") / 2)
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.col("__next.text"), F.lit(1), half.cast("int")))
    rows = rows.select("doc_id", "n_chars", "fp", edited.alias("edited"), F.col("__next.fp").alias("next_fp"))
    rows = rows.withColumn("edited_fp", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
