"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL only.

A text is cut into paragraphs (a line or sentence with its end, at most ``PARAGRAPH`` characters),
and each distinct paragraph's 63-bit digest is put into one cell of each of three sub-tables; a cell
holds a count and the exclusive or of its digests and of their check hashes. Sketches of two
versions subtract cell by cell. Peeling then finds the cells left with one digest, takes it out of
its other cells, and so recovers the digests that differ. If cells remain, larger sketches are
taken: the digests are sorted, which brings the shards (the digests that share their first bits,
about eight) together, and each shard gets a table of its own, which doubles until it peels.
Sorting aside, the work is a constant for each digest. Every size places digests by a hash of its
own, so a shard that one size cannot decode is dealt anew by the next.

The next document is found by ranges of the key: quantiles cut the keys into at most
``MAX_BUCKETS`` buckets, each bucket is ordered by itself, and the first document of a bucket
is also sent to the bucket that comes before it in descending order. Digests and cells travel
with a text, so they are taken once.

Defined results: a null text is empty; an empty text has no paragraph, and two such are alike (1);
a row with a null key has a fingerprint but no next document, hence null edited and near columns;
rows that share a key are ordered by text; the next of a single document is itself; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH = 200
MAX_BUCKETS = 65_536
ROWS_PER_BUCKET = 128
#: Bits that number the cells of each sub-table: of the fingerprint, then of a shard, from the first try to the last.
BASE_BITS, FIRST_BITS, LAST_BITS = 2, 3, 20
ROUNDS = 10


def digests(text: str) -> str:
    """SQL: the distinct digests of a text's paragraphs; their last bit is 0, it tells two sides apart later."""
    units = rf"regexp_extract_all({text}, '[^\n.!?]{{1,{PARAGRAPH}}}[\n.!?]*|[\n.!?]+', 0)"
    return f"array_distinct(transform({units}, u -> xxhash64(u) & -2L))"


def _placed(entries: str, bits: str) -> str:
    """SQL: digest, sign, check hash and a cell per sub-table of entries: digests, those to take away with their last bit set.

    A digest's cells are parts of its hash for this number of bits.
    """
    cells = ", ".join(f"'i{j}', shiftright(h, {20 * j}) & (shiftleft(1L, {bits}) - 1L)" for j in range(3))
    one = f"named_struct('d', e & -2L, 's', if((e & 1L) = 0L, 1, -1), 'c', xxhash64(e & -2L), {cells})"
    return f"transform({entries}, e -> element_at(transform(array(xxhash64(e & -2L, {bits})), h -> {one}), 1))"


def _sketch(entries: str, bits: str) -> str:
    """SQL: the cells of some entries, the sub-tables one after the other."""
    zero = "named_struct('n', 0, 'k', 0L, 'c', 0L)"
    cell = lambda j: f"aggregate(qs, {zero}, (a, q) -> if(q.i{j} = p, named_struct('n', a.n + q.s, 'k', a.k ^ q.d, 'c', a.c ^ q.c), a))"
    tables = ", ".join(f"transform(sequence(0L, shiftleft(1L, {bits}) - 1L), p -> {cell(j)})" for j in range(3))
    return f"element_at(transform(array({_placed(entries, bits)}), qs -> concat({tables})), 1)"


def _minus(x: str, y: str) -> str:
    return f"zip_with({x}, {y}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def _peel(cells: str, bits: str) -> str:
    """SQL: struct of the numbers of digests recovered on the plus and the minus side, and whether all peeled.

    A round takes every cell's lone digest out of all its cells. It is the last if it finds none, or if
    what it found makes up what all cells hold together, counts, digests and check hashes.
    """
    lone = "array_distinct(transform(filter(s.cells, x -> abs(x.n) = 1 and x.c = xxhash64(x.k)), x -> x.k | if(x.n < 0, 1L, 0L)))"
    sums = lambda of, n, k, c: f"aggregate({of}, named_struct('n', 0, 'k', 0L, 'c', 0L), (a, x) -> named_struct('n', a.n + {n}, 'k', a.k ^ {k}, 'c', a.c ^ {c}))"
    whole = f"{sums('g', 'if((x & 1L) = 0L, 1, -1)', '(x & -2L)', 'xxhash64(x & -2L)')} = {sums(f'slice(s.cells, 1, cast(shiftleft(1, {bits}) as int))', 'x.n', 'x.k', 'x.c')}"
    new = "named_struct('cells', {0}, 'plus', s.plus + size(filter(g, x -> (x & 1L) = 0L)), 'minus', s.minus + size(filter(g, x -> (x & 1L) = 1L)), 'live', {1}, 'done', {2})"
    none = "named_struct('cells', s.cells, 'plus', s.plus, 'minus', s.minus, 'live', false, 'done', forall(s.cells, x -> x.n = 0 and x.k = 0L and x.c = 0L))"
    step = f"element_at(transform(array({lone}), g -> if(size(g) = 0, {none}, if({whole}, {new.format('s.cells', 'false', 'true')}, {new.format(_minus('s.cells', _sketch('g', bits)), 'true', 'false')}))), 1)"
    start = f"named_struct('cells', {cells}, 'plus', 0, 'minus', 0, 'live', true, 'done', false)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(s.live, {step}, s), s -> named_struct('plus', s.plus, 'minus', s.minus, 'done', s.done))"


def _decoded(shard: str) -> str:
    """SQL: what a shard's sketches tell, the size doubled until their difference peels.

    A shard is an array of entries, those of the second side with their last bit set: the sketches of
    both sides are subtracted as they are filled.
    """
    tried = f"element_at(transform(array({shard}), v -> {_peel(_sketch('v', 'b'), 'b')}), 1)"
    return f"aggregate(sequence({FIRST_BITS}, {LAST_BITS}), named_struct('plus', 0, 'minus', 0, 'done', false), (z, b) -> if(z.done, z, {tried}))"


def _printed(cells: str, digest: str) -> str:
    """SQL: a sketch as text: the digests' number and every cell's three values."""
    return f"concat(size({digest}), ':', array_join(transform({cells}, x -> concat(x.n, '.', hex(x.k), '.', hex(x.c))), ','))"


def _likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add ``name``: the Jaccard likeness of digests ``a`` and ``b`` as their sketches' difference tells."""
    df = df.withColumn("_base", F.expr(_peel(_minus(f"cells_{a}", f"cells_{b}"), str(BASE_BITS))))
    # sorted, the digests of a shard (those that share their first bits) stand together
    df = df.withColumn("_all", F.expr(f"if(_base.done, cast(array() as array<bigint>), sort_array(concat({a}, transform({b}, d -> d | 1L))))"))
    df = df.withColumn("_skip", F.expr("64 - greatest(1, cast(ceil(log2(size(_all) / 8 + 1e-9)) as int))"))
    df = df.withColumn("_from", F.expr("filter(transform(_all, (d, i) -> if(i = 0 or shiftright(d, _skip) != shiftright(_all[greatest(i - 1, 0)], _skip), i, -1)), i -> i >= 0)"))
    df = df.withColumn("_parts", F.expr(f"transform(_from, (f, i) -> {_decoded('transform(sequence(f, if(i + 1 < size(_from), _from[i + 1], size(_all)) - 1), m -> _all[m])')})"))
    told = "aggregate(_parts, named_struct('plus', 0, 'done', true), (x, z) -> named_struct('plus', x.plus + z.plus, 'done', x.done and z.done))"
    df = df.withColumn("_told", F.expr(f"if(_base.done, named_struct('plus', _base.plus, 'done', true), {told})"))
    df = df.withColumn("_plus", F.expr("if(not _told.done, raise_error('a difference of sketches did not peel'), _told.plus)"))
    union = F.size(b) + F.col("_plus")
    return df.withColumn(name, F.when(union == 0, 1.0).otherwise((F.size(a) - F.col("_plus")) / union)).drop("_base", "_all", "_skip", "_from", "_parts", "_told", "_plus")


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, own (digests), cells_own and next (struct of these three of the next document by descending key, the first's after the last)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = lambda df: df.withColumn("own", F.expr(digests("text"))).withColumn("cells_own", F.expr(_sketch("own", str(BASE_BITS))))
    placed = rows.filter("key is not null")
    n = placed.select("key").count()
    buckets = max(1, min(MAX_BUCKETS, n // ROWS_PER_BUCKET))
    coarse = min(256, buckets)
    cuts = sorted(set(placed.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [i / coarse for i in range(coarse + 1)], 0.001))) if n else [0.0]
    placed = placed.withColumn("bucket", _bucket(F.col("key").cast("double"), cuts, -(-buckets // coarse)))

    heads = placed.groupBy("bucket").agg(F.max("key").alias("key"))  # at most MAX_BUCKETS plus 256 rows
    every = Window.partitionBy()
    heads = heads.select("key", F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.min("bucket").over(every)).alias("to"))
    # a head goes to its own bucket and, as a guest, to the one before
    sent = told(placed.join(F.broadcast(heads), "key", "left"))
    sent = sent.withColumn("_to", F.explode(F.when(F.col("to").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("to").alias("b"), F.lit(True).alias("guest"))))))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "text")
    both = sent.select("key", "text", "own", "cells_own", F.col("_to.b").alias("bucket"), F.col("_to.guest").alias("guest"))
    found = both.withColumn("next", F.lead(F.struct("text", "own", "cells_own")).over(order)).filter("not guest").select("key", "text", "own", "cells_own", "next")
    kind = found.schema["next"].dataType.simpleString()
    return found.unionAll(told(rows.filter("key is null")).select("key", "text", "own", "cells_own", F.lit(None).cast(kind).alias("next")))


def _bucket(key: Column, cuts: list[float], fine: int) -> Column:
    """The range of quantiles that a key lies in, cut into ``fine`` equal parts."""
    if len(cuts) < 2:
        return F.lit(0).cast("long")
    edges = F.array(*map(F.lit, cuts))
    at = F.greatest(F.lit(1), F.least(F.lit(len(cuts) - 1), F.size(F.filter(edges, lambda e: e <= key))))
    low, high = F.element_at(edges, at), F.element_at(edges, at + 1)
    part = F.floor((key - low) / (high - low) * fine)
    return (at * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), part))).cast("long")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last third of code points replaced by as many of the next document.
    """
    df = with_next(docs, key, text).withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next.text, 1, cast(n_chars div 3 as int)))"))
    df = df.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "cells_own", F.expr(digests("edited")).alias("alt"), F.col("next.own").alias("nxt"), F.col("next.cells_own").alias("cells_nxt"))
    df = df.withColumn("cells_alt", F.expr(_sketch("alt", str(BASE_BITS))))
    df = df.withColumn("fingerprint", F.expr(_printed("cells_own", "own"))).withColumn("edited_fingerprint", F.expr(_printed("cells_alt", "alt")))
    df = _likeness(_likeness(df, "own", "alt", "near_edited"), "own", "nxt", "near_next")
    return df.select(F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
