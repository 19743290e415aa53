"""Document fingerprints by Order MinHash (after Marçais et al., 2019), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallychain.llm.common import staged
from tallychain.operators.numbering import with_previous

#: Bytes of a k-mer, and the bits that tell the buckets of a fingerprint apart. Each bucket selects two k-mers.
K, BUCKET_BITS = 12, 6
#: Start positions of a piece of a text, from 1: what is held of one text at once; a position takes 16 of a number's 64 bits.
PLACE_BITS = 16
PIECE = (1 << PLACE_BITS) - 1
#: K-mers of a bucket that are sorted, by expectation, before all are where a bucket has fewer than two of these.
LIKELY = 16
#: Ids that one window partition spans, and rows of two numbers that are broadcast: 8 MB at most.
SPAN, FEW = 512, 400_000


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _bucket(h: Column) -> Column:
    return F.shiftright(h, 64 - BUCKET_BITS)


def _with(value: Column, f) -> Column:
    """f of a value that is computed once, as a function's variable; a column would be computed, or copied, at each use."""
    return F.transform(F.array(value), f)[0]


def _least(kmers: Column, value) -> Column:
    """Of k-mers in order of their value, the first two of each bucket."""
    return F.filter(kmers, lambda x, i: (i < 2) | (_bucket(value(F.get(kmers, i - 2))) != _bucket(value(x))))


def _piece(part: Column, at: Column) -> Column:
    """The least k-mers of each bucket in a piece's bytes, (hash, place in the text). A hash's 48 bits stand above the place in the piece, so that
    one sort of plain numbers orders k-mers, and equal ones by their place. Where every bucket has two of the lowest values, only these are sorted."""
    n = F.greatest(F.octet_length(part) - (K - 1), F.lit(1))
    packed = F.transform(F.sequence(_long(1), n.cast("long")), lambda i: F.shiftleft(F.xxhash64(F.substring(part, i.cast("int"), F.lit(K))), PLACE_BITS).bitwiseOR(i))
    whole = lambda p: _with(F.sort_array(p), lambda s: _least(s, lambda x: x))
    inside, most = _long((1 << 64 - BUCKET_BITS) - 1), float(LIKELY << 64)
    low = lambda p: _with((most / F.size(p)).cast("long"), lambda top: F.filter(p, lambda x: x.bitwiseAND(inside) < top))
    few = lambda p: F.when(F.size(p) <= 2 * LIKELY << BUCKET_BITS, F.array().cast("array<long>")).otherwise(whole(low(p)))
    held = _with(packed, lambda p: _with(few(p), lambda k: F.when(F.size(k) == 2 << BUCKET_BITS, k).otherwise(whole(p))))
    return F.transform(held, lambda x: F.struct(F.shiftright(x, PLACE_BITS).alias("h"), (x.bitwiseAND(_long((1 << PLACE_BITS) - 1)) + at).alias("place")))


def _numbers(least: Column) -> Column:
    """One number for each bucket of the k-mers, which are in order of their hashes: its one or two, in the order of the text, hashed.

    Two k-mers of one hash are its first and second occurrence, two of different hashes are both first ones, so hashes say the numbers too.
    """
    top = lambda x: F.shiftright(x["h"], 64 - PLACE_BITS - BUCKET_BITS)
    bits = (1 << BUCKET_BITS) - 1

    def pair(x: Column, y: Column) -> Column:
        alone = y.isNull() | (top(x) != top(y))
        made = F.when(alone, F.xxhash64(x["h"])).when(y["place"] < x["place"], F.xxhash64(y["h"], x["h"])).otherwise(F.xxhash64(x["h"], y["h"]))
        return made.bitwiseAND(_long(~bits)).bitwiseOR(top(x).bitwiseAND(_long(bits)))

    def one(x: Column, i: Column) -> Column:
        first = (i == 0) | (top(F.get(least, i - 1)) != top(x))
        return F.when(first, _with(F.get(least, i + 1), lambda y: pair(x, y)))

    return F.filter(F.transform(least, one), lambda x: x.isNotNull())


def fingerprint(text: Column) -> Column:
    """array<long>, one number for each bucket that a k-mer of the text falls in; empty for an empty or null text.

    A text's k-mers are its runs of K UTF-8 bytes (a shorter text is one k-mer), numbered by occurrence. They are ordered by their XXH64 (its
    low 48 bits) and then by that number; the top bits are the bucket. Each bucket selects its two least ones, puts them in the order
    in which they stand in the text and hashes that pair, so equal parts in another order give other numbers. A number's low bits are its bucket.

    A text is hashed piece by piece; the least of the pieces' least are the text's, with their numbers, as equal k-mers are ordered by place.
    """
    many = lambda b: F.ceil(F.greatest(F.octet_length(b) - (K - 1), F.lit(1)) / F.lit(PIECE)).cast("int")
    cut = lambda b, j: _with(F.substring(b, j * PIECE + 1, F.lit(PIECE + K - 1)), lambda p: _piece(p, j.cast("long") * PIECE))
    pieces = lambda b: F.transform(F.sequence(F.lit(0), many(b) - 1), lambda j: cut(b, j))
    merged = lambda p: F.when(F.size(p) == 1, p[0]).otherwise(_with(F.sort_array(F.flatten(p)), lambda s: _least(s, lambda x: F.shiftleft(x["h"], PLACE_BITS))))
    found = _with(text.cast("binary"), lambda b: _with(pieces(b), lambda p: _with(merged(p), _numbers)))
    return F.when(F.octet_length(text) > 0, found).otherwise(F.array().cast("array<long>"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal numbers among the buckets that either fingerprint has; 1 for two empty ones."""
    buckets = lambda f: F.transform(f, lambda x: x.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1).cast("long")))
    either = F.size(F.array_union(buckets(a), buckets(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def shown(f: Column) -> Column:
    """A fingerprint as text: 16 hex digits for each number."""
    return F.array_join(F.transform(f, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", made: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, *made, next: struct(text, *made)) for each row of docs: the row after it by id, null ids last, then by text; after the last the first.
    made are columns computed of `text` before rows move.

    Rows meet those of their span of ids, by one shuffle. The first row of each span also goes to the span before that has rows, which is found
    on the ids alone; these first rows, one in SPAN where ids are dense, are read a second time.
    """
    made = made or {}
    late = F.lit(1 << 62).cast("long")
    span = F.coalesce(F.floor(F.col("doc_id") / F.lit(SPAN)).cast("long"), late)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    firsts = rows.select("doc_id", span.alias("span")).groupBy("span").agg(F.min("doc_id").alias("first"))
    before = staged(with_previous(firsts, "span", "span", "to", "span"), "spans")
    ends = before.agg(F.max("span"), F.count("*")).first()
    before = before.select(F.col("span").alias("of"), F.coalesce("to", F.lit(ends[0])).cast("long").alias("to"), (F.col("to").isNull()).alias("around"))
    # the first row of a span: of those of its first id, the one of the least text
    asked = before.join(firsts, F.col("of") == F.col("span")).select("first", "to", "around")
    met = rows.join(F.broadcast(asked) if ends[1] <= FEW else asked, F.col("doc_id").eqNullSafe(F.col("first")))
    heads = met.groupBy("to", "around", "doc_id").agg(F.min("text").alias("text"))
    every = lambda df, to, last: df.select("doc_id", "text", to.alias("span"), last.alias("last"), *[c.alias(k) for k, c in made.items()])
    both = every(rows, span, F.lit(0)).union(every(heads, F.col("to"), F.lit(1)))
    order = Window.partitionBy("span").orderBy("last", F.col("doc_id").asc_nulls_last(), "text")
    following = F.lead(F.struct("text", *made)).over(order).alias("next")
    return both.select("doc_id", "text", *made, "last", following).where("last = 0").drop("last")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones, or all, of the next document (see with_next). Null texts
    are empty; the likeness of two empty texts is 1. A document on its own is followed by itself. Repeated rows follow each other. An empty
    table gives an empty table. Only the id and the text are read.
    """
    rows = with_next(docs, id_col, text_col, {"print": fingerprint(F.col("text"))})
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", F.col("next.print").alias("next_print"))
    rows = rows.select("*", fingerprint(F.col("edited")).alias("edited_print"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("print")).alias("fingerprint"), shown(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
