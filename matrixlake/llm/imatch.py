"""Document fingerprints by I-Match, in DataFrame and SQL functions only.

A text's distinct lower-case words, those of a chosen band of inverse document frequency, are sorted; the whole list and
randomised subsets of the lexicon are hashed one by one. The subsets come in levels that keep one word of 8, 32, 128 and
512, eight subsets each, so that short and long texts alike have subsets of a few words.

The lexicon is a bitmap of 2^20 slots over word hashes: a slot is in when the number of documents with a word there lies
in the band. Its size is fixed (128 KB), so it travels inside the plan and no join or broadcast follows the vocabulary.
The words of a slot stand or fall together: among 280,000 words, 24 % of those of a single document are let in by
their slot mates, more in a larger vocabulary, and 0.05 % of the words in the band are lost. A text without any word in
the band has the hash of all its words (without words: of its characters) for the whole list, and only empty subsets.

Likeness: at each level the share of subsets with equal hashes among those that are not empty in both (half of the
level's subsets at least); the best level counts. Equal fingerprints have likeness 1.

Documents follow one another in ascending doc_id (null first, then by text). Neighbours are found within ranges of
(doc_id, text), cut at quantiles of a sample of rows so that clustered, repeated and null ids make no long range, and the
first text of the next range is handed to the last row, so no task sees all rows.

Defined results: a null or empty text has no words and only empty subsets; two such texts have likeness 1; the only row
follows itself; rows with equal ids are neighbours by text; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

SLOT_BITS = 20
#: Documents with a word, as a share of all: the band of the lexicon. A word of one document alone says nothing.
BAND, LEAST_DOCS = (0.0002, 0.05), 2
LEVELS, SUBSETS = (3, 5, 7, 9), 8
#: Rows that are looked at for each range.
LOOKED = 64


def _words(text: str) -> str:
    return rf"filter(array_distinct(split(lower({text}), '[^\\p{{L}}\\p{{N}}]+')), w -> w != '')"


def lexicon(docs: DataFrame) -> str:
    """The bitmap as SQL: an array of 64-bit numbers."""
    slots = docs.select(F.explode(F.expr(f"array_distinct(transform({_words('text')}, w -> pmod(xxhash64(w), {1 << SLOT_BITS})))")).alias("slot"))
    counts = slots.groupBy("slot").agg(F.count("*").alias("n"))
    n = docs.count()
    low, high = max(LEAST_DOCS, BAND[0] * n), max(BAND[1] * n, LEAST_DOCS)
    kept = counts.filter((F.col("n") >= low) & (F.col("n") <= high))
    bits = kept.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    for r in bits.collect():  # 2^14 rows at most
        out[r["at"]] = r["bits"]
    return f"cast(split('{','.join(map(str, out.tolist()))}', ',') as array<bigint>)"


def fingerprint(df: DataFrame, text: str, name: str, bitmap: str) -> DataFrame:
    """df with `name`: the hashes of the whole list and of each subset, '-' for an empty one."""
    df = df.withColumn("_words", F.expr(f"array_sort({_words(text)})"))
    df = df.withColumn("_terms", F.expr("transform(_words, w -> named_struct('w', w, 'h', xxhash64(w)))"))
    df = df.withColumn("_terms", F.expr(f"filter(_terms, t -> getbit(element_at({bitmap}, cast(shiftright(pmod(t.h, {1 << SLOT_BITS}), 6) as int) + 1), cast(t.h & 63 as int)) = 1)"))
    at, levels = SLOT_BITS, []
    for bits in LEVELS:
        levels.append(f"named_struct('by', {at}, 'mask', {(1 << bits) - 1}L)")
        at += bits
    hashed = "if(size({0}) = 0, '-', substr(lpad(hex(xxhash64({0})), 16, '0'), 1, 8))"
    df = df.withColumn("_levels", F.expr(f"transform(array({', '.join(levels)}), l -> named_struct('by', l.by, 'mask', l.mask, 'terms', filter(_terms, t -> (shiftright(t.h, l.by) & l.mask) < {SUBSETS})))"))
    subset = "transform(filter(l.terms, t -> (shiftright(t.h, l.by) & l.mask) = j), t -> t.w)"
    df = df.withColumn("_subsets", F.expr(f"concat(array(transform(_terms, t -> t.w)), flatten(transform(_levels, l -> transform(sequence(0, {SUBSETS - 1}), j -> {subset}))))"))
    df = df.withColumn(name, F.expr(f"transform(_subsets, s -> {hashed.format('s')})"))
    bare = f"if({text} = '', '-', concat('~', substr(lpad(hex(xxhash64(_words, if(size(_words) = 0, {text}, ''))), 16, '0'), 1, 8)))"
    return df.withColumn(name, F.expr(f"if(size(_terms) = 0, concat(array({bare}), slice({name}, 2, {len(LEVELS) * SUBSETS})), {name})")).drop("_words", "_terms", "_levels", "_subsets")


def likeness(a: str, b: str) -> Column:
    levels = []
    for k in range(len(LEVELS)):
        mine = f"zip_with(slice({a}, {2 + k * SUBSETS}, {SUBSETS}), slice({b}, {2 + k * SUBSETS}, {SUBSETS}), (x, y) -> if(x = '-' and y = '-', 0, if(x = y, 101, 1)))"
        levels.append(f"aggregate({mine}, 0, (s, x) -> s + x, s -> (s div 100) / cast(greatest(s % 100, {SUBSETS // 2}) as double))")
    return F.expr(f"if({a} = {b}, 1.0D, greatest({', '.join(levels)}))")


def ranges(docs: DataFrame) -> Column:
    """A column with the number of the row's range in the order of (doc_id, text); ranges hold about as many rows."""
    n = partitions(docs.sparkSession)
    # a text of hexadecimal digits that sorts as (doc_id, beginning of the text) does
    key = "concat(if(doc_id is null, '0', concat('1', lpad(hex(doc_id ^ shiftleft(1L, 63)), 16, '0'))), hex(cast(substr(text, 1, 12) as binary)))"
    looked = docs.select(F.expr(key).alias("key"), F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "key").limit(n * LOOKED).select("key").collect()
    keys = sorted(r.key for r in looked)
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    if not bounds:
        return F.lit(0)
    wide = max(1, int(len(bounds) ** 0.5))  # the bounds in groups, so that a row looks at two short lists
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    heads, lists = ",".join(g[0] for g in groups), ";".join(",".join(g) for g in groups)
    group = f"named_struct('k', k, 'g', size(filter(split('{heads}', ','), b -> b <= k)))"
    place = f"if(x.g = 0, 0, (x.g - 1) * {wide} + size(filter(split(element_at(split('{lists}', ';'), x.g), ','), b -> b <= x.k)))"
    return F.expr(f"element_at(transform(transform(array({key}), k -> {group}), x -> {place}), 1)")


def fingerprints(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bitmap = lexicon(docs)
    range_ = ranges(docs)
    first = docs.select("doc_id", range_.alias("range")).groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), F.col("doc_id").alias("id"))).alias("first"))
    firsts = sorted((r["range"], r["first"]["id"]) for r in first.collect())  # a row a range
    before = {r: firsts[i - 1][0] for i, (r, _) in enumerate(firsts)}
    ids, nulls = [i for _, i in firsts if i is not None], any(i is None for _, i in firsts)
    chosen = docs.filter(F.col("doc_id").isin(ids) | (F.lit(nulls) & F.col("doc_id").isNull())) if firsts else docs
    heads = chosen.withColumn("range", range_).groupBy("range").agg(F.min_by("text", F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("text"))).alias("head"))
    back = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range")) if before else F.lit(0)
    heads = fingerprint(heads.select(back.alias("_range"), "head"), "head", "head_marks", bitmap)

    marked = fingerprint(docs, "text", "marks", bitmap).withColumn("range", range_)
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    led = marked.withColumn("_next", F.lead(F.struct("text", "marks")).over(order))
    met = led.join(heads, (F.col("range") == F.col("_range")) & F.col("_next").isNull(), "left")
    next_text, next_marks = (F.coalesce(F.col(f"_next.{a}"), F.col(b)) for a, b in (("text", "head"), ("marks", "head_marks")))
    rows = met.select("doc_id", "text", "marks", next_text.alias("next_text"), next_marks.alias("next_marks"), F.length("text").cast("bigint").alias("n_chars"))
    cut = "cast(n_chars div 4 as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {cut}), substring(next_text, 1, {cut}))"))
    rows = fingerprint(rows, "edited", "edited_marks", bitmap)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array_join("marks", ":").alias("fingerprint"),
        F.array_join("edited_marks", ":").alias("edited_fingerprint"), likeness("marks", "edited_marks").alias("near_edited"), likeness("marks", "next_marks").alias("near_next"),
    )
