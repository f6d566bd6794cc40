"""Document fingerprints by Order MinHash, with column expressions only.

The k-mers of a text are runs of WORDS words; a long word counts as all its pieces of LONG characters, so that an edit
in text without spaces changes only the pieces around it. Each gets the number of its earlier occurrences, so repeats count apart.
There are BUCKETS sketches. Sketch b orders the hashes of (k-mer, number) from the start of the b-th of as many ranges on,
around the end to the start again; of the whole text the two first in this order are put back into text order and hashed
as a tuple. Long texts have two k-mers in each range; in short ones a sketch goes on to those of later ranges. Two texts
agree on a sketch when the same k-mers are selected and stand in the same order there, so agreement falls with edits that
move text as well as with edits that replace it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.exprs import let

WORDS = 3
BUCKETS = 64  # sketches and ranges, by the top six bits of a hash
BLOCK_BITS = 10  # documents with the same id but for so many bits are one group when neighbours are looked up
UPPER_BITS = 18  # block numbers with the same number but for so many bits are one group
LONG = 16  # characters of a word, over which it is taken apart
_WORD = r"[^\x20\x09-\x0D]+"


def _top(x: Column) -> Column:
    return F.shiftright(x, 58) + 32  # ascending as the signed hashes are


def _occurrence(s: Column, bits: Column) -> Column:
    """(number, position) packed as number << 32 | position, for each element hash | position of the sorted array s."""

    def number(groups: Column, g: Column, i: Column) -> Column:
        def within(n: int, longer: Column) -> Column:
            start = F.greatest(i - n, F.lit(0))
            full = (F.get(groups, start) == g) & (start > 0)
            return F.when(full, longer).otherwise(i - start - F.array_position(F.slice(groups, start + 1, n + 1), g) + 1)

        def halved(at: Column, _: Column) -> Column:
            """One step of the search for the first place of g, between at.lo and at.hi."""
            middle = F.shiftright(at["lo"] + at["hi"], 1)
            return let(middle, lambda m: F.when(F.get(groups, m) < g, F.struct(F.least(m + 1, at["hi"]).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), m.alias("hi"))))

        searched = i - F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.lit(0).alias("lo"), i.alias("hi")), halved)["hi"]
        one_before = (i > 0) & (F.get(groups, i - 1) == g)
        return F.when(one_before, within(8, within(128, searched))).otherwise(F.lit(0)).cast("long")

    return let(F.transform(s, lambda x: F.call_function("shiftright", x, bits)), lambda groups: F.transform(s, lambda x, i: F.call_function("shiftleft", number(groups, F.get(groups, i), i), F.lit(32)).bitwiseOR(x - F.call_function("shiftleft", F.get(groups, i), bits))))


def _is_long(word: Column) -> Column:
    return F.length(word) > LONG


def _pieces(words: Column) -> Column:
    """The words, with every piece of LONG characters in place of a longer one."""

    def cut(word: Column) -> Column:
        def of(c: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(c) - (LONG - 1)), lambda i: F.array_join(F.slice(c, i, F.lit(LONG)), ""))

        return F.when(_is_long(word), let(F.split(word, ""), of)).otherwise(F.array(word))

    return F.flatten(F.transform(words, cut))


def _kmers(words: Column, k: int) -> Column:
    n = F.size(words)
    whole = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(words)))
    return F.when(n < k, whole).otherwise(F.transform(F.slice(words, F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)])))


def _pairs(s: Column, hashes: Column, mask: Column) -> Column:
    """Of the sorted hashes with positions s: per sketch one long, the sketch and the hash of its two in text order."""
    # the two smallest of each range are enough to find the two that follow the start of any range
    kept = F.filter(s, lambda x, i: (i < 2) | (_top(F.get(s, F.greatest(i - 2, F.lit(0)))) != _top(x)))

    def tuples(sel: Column) -> Column:
        last = _top(F.element_at(sel, -1)).cast("int")

        def one(x: Column, i: Column) -> Column:
            top = _top(x).cast("int")
            before = F.when(i == 0, F.lit(-1)).otherwise(_top(F.get(sel, F.greatest(i - 1, F.lit(0)))).cast("int"))
            y = F.coalesce(F.get(sel, i + 1), F.get(sel, F.lit(0)))
            px, py = x.bitwiseAND(mask), y.bitwiseAND(mask)
            at = lambda p: F.get(hashes, p.cast("int"))
            code = F.when(F.size(sel) == 1, F.xxhash64(at(px))).when(px < py, F.xxhash64(at(px), at(py))).otherwise(F.xxhash64(at(py), at(px)))
            # the sketches that begin past the range before and up to x's own; the first one has those past the last range, too
            own = F.sequence(before + 1, top)
            sketches = F.when((i == 0) & (last < BUCKETS - 1), F.concat(own, F.sequence(F.least(last + 1, F.lit(BUCKETS - 1)), F.lit(BUCKETS - 1)))).otherwise(own)
            packed = let(code.bitwiseAND(F.lit((1 << 34) - 1)), lambda c: F.transform(sketches, lambda r: F.call_function("shiftleft", r.cast("long"), F.lit(34)).bitwiseOR(c)))
            return F.when(before < top, packed)

        return F.sort_array(F.flatten(F.filter(F.transform(sel, one), lambda v: v.isNotNull())))

    return F.when(F.size(s) == 0, s).otherwise(let(kept, tuples))


def fingerprint(text: Column, k: int = WORDS) -> Column:
    """array<bigint>: for each sketch, its number << 34 | hash of the selected tuple, ascending.

    Equal texts have equal fingerprints. Fewer than k words are one k-mer; null, empty and blank texts have none.
    """

    def of_kmers(kh: Column) -> Column:
        bits = F.greatest(F.ceil(F.log2(F.size(kh) + F.lit(2))), F.lit(1)).cast("int")

        def with_bits(b: Column) -> Column:
            def packed(h: Column, i: Column) -> Column:
                return F.call_function("shiftleft", F.call_function("shiftright", h, b), b) + i

            low = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
            # by position: the hash of k-mer and number
            numbered = let(
                F.when(F.size(F.array_distinct(kh)) == F.size(kh), kh).otherwise(
                    let(
                        F.sort_array(_numbers(kh, packed, b)),
                        lambda rows: F.transform(rows, lambda r, i: let(F.get(kh, i), lambda h: let(r.bitwiseAND(F.lit((1 << 31) - 1)), lambda o: F.when(o == 0, h).otherwise(F.xxhash64(h, o))))),
                    )
                ),
                lambda hs: let(F.sort_array(F.transform(hs, packed)), lambda s: _pairs(s, hs, low)),
            )
            return numbered

        return let(bits, with_bits)

    def _numbers(kh: Column, packed, b: Column) -> Column:
        """position << 31 | number, to be sorted by position."""
        return let(
            F.sort_array(F.transform(kh, packed)),
            lambda s: F.transform(
                _occurrence(s, b),
                lambda x: F.call_function("shiftleft", x.bitwiseAND(F.lit((1 << 32) - 1)), F.lit(31)).bitwiseOR(F.call_function("shiftright", x, F.lit(32))),
            ),
        )

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))
    return let(words, lambda w: let(F.when(F.exists(w, _is_long), _pieces(w)).otherwise(w), lambda p: let(_kmers(p, k), of_kmers)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketches of either fingerprint on which both agree; 1 for two empty ones."""
    ranges = lambda x: F.transform(x, lambda v: F.shiftright(v, 34))
    common = F.size(F.array_intersect(ranges(a), ranges(b)))
    filled = F.size(a) + F.size(b) - common
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(filled, F.lit(1)).cast("double"))


def printed(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v)), 10, "0")), "")


def _follows(values: DataFrame, bits: int = 64 - BLOCK_BITS) -> DataFrame:
    """(v, next): the next larger of distinct values, the smallest for the largest. No window has over 2^UPPER_BITS rows, but for one of nulls."""
    if bits <= UPPER_BITS:
        return values.select("v", F.coalesce(F.lead("v").over(Window.orderBy("v")), F.min("v").over(Window.partitionBy())).alias("next"))
    at = values.withColumn("u", F.shiftright("v", UPPER_BITS))
    starts = at.groupBy("u").agg(F.min("v").alias("start"))
    uppers = _follows(starts.select(F.col("u").alias("v")), bits - UPPER_BITS).withColumnRenamed("v", "u").withColumnRenamed("next", "next_u")
    after = uppers.join(starts.withColumnRenamed("u", "next_u"), "next_u").select("u", "start")
    inner = at.withColumn("inside", F.lead("v").over(Window.partitionBy("u").orderBy("v")))
    return inner.join(after, "u").select("v", F.coalesce("inside", "start").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (id, text, fp) with next_text and next_fp of the next id; the first follows the last.

    Neighbours are found within blocks of ids; a block's last row takes the first row of the next block that has any.
    Only block numbers go through the windows over blocks, in blocks of blocks of blocks and so on.
    """
    block = F.coalesce(F.shiftright("id", BLOCK_BITS), F.lit(-(1 << 62)))
    docs = docs.withColumn("block", block)
    order = Window.partitionBy("block").orderBy("id", "text")
    inner = docs.withColumn("nxt", F.lead(F.struct("text", "fp")).over(order))
    firsts = docs.groupBy("block").agg(F.min(F.struct("id", "text")).alias("first"))
    follows = _follows(docs.select("block").distinct().withColumnRenamed("block", "v")).select(F.col("v").alias("block"), F.col("next").alias("next_block"))
    heads = follows.join(firsts.withColumnRenamed("block", "next_block"), "next_block").select("block", F.col("first.text").alias("h_text"))
    heads = heads.withColumn("h_fp", fingerprint(F.col("h_text")))
    joined = inner.join(heads, "block", "left")
    return joined.select("id", "text", "fp", F.coalesce("nxt.text", "h_text").alias("next_text"), F.coalesce("nxt.fp", "h_fp").alias("next_fp"))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text: the last floor(n_chars / 2) code points are replaced by the first as many of the next document's.
    Null texts are empty; rows with a null id come first; equal ids are ordered by text. A lone document follows itself.
    Other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("fp", fingerprint(F.col("text")))
    both = with_next(base)
    half = F.expr("length(text) div 2").cast("int")
    n = F.length("text")
    both = both.select("id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    both = both.select("id", "n_chars", "fp", "next_fp", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("efp"))
    return both.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", printed(F.col("fp")).alias("fingerprint"), printed(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
