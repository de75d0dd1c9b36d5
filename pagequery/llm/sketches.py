"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with SQL functions only.

A paragraph is a line, or of a longer line what lies between sentence ends that their last letter chooses; the first 1, 2, 4, 8 and 16 words of a text count as paragraphs
too, so that a text of a single sentence has something to share. A paragraph's digest is its 64-bit xxHash. A sketch has HASHES rows of
SLOTS cells, and every digest goes into one cell of each row: a cell has the number of its digests, their XOR, and the XOR of
their checksums. Sketches of two versions subtract cell by cell, what they share cancels, and peeling recovers what differs: a
cell with one digest, as its checksum proves, gives it away, and taking it out of its other cells frees further ones. Where cells
are left over, the digests are sketched again, with other hashes and four times as many cells: they are dealt into four parts, each
with a sketch of its own, and so on.

A text of many paragraphs is dealt into parts of about PART digests from the start, so the work of a sketch is bounded, and that
of a text grows with its paragraphs and the square root of their parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SLOTS, HASHES = 4, 3
#: Digests of a part of a pair of texts, on average.
PART = 4
#: Rounds of peeling at most; what takes more is retried.
ROUNDS = 2 * SLOTS * HASHES
#: Parts of the retries, each as many times as large as the one before; two digests would have to fall together at random in all of them.
LADDER = (1, 4, 16, 64, 256, 1024)
#: What ends a paragraph within a line, and stays with it: the ends of about a third of all sentences, by their last letter.
ENDS = ("a. ", "e. ", "n. ", "! ", "? ", "\u3002", "\uff01", "\uff1f")
#: Documents that are ordered together, on average; beyond so many times that number in one range of ids, ranks are used.
RANGE_DOCS, UNEVEN = 1000, 20

_ZERO = "named_struct('c', 0, 'k', 0L, 'h', 0L)"
_SUM = "named_struct('c', s.c + 1, 'k', s.k ^ d, 'h', s.h ^ (xxhash64(d, 7) & 4294967295L))"
_MINUS = "zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def digests(text: Column) -> Column:
    """The different digests of a text's paragraphs (null: those of an empty text)."""
    text = F.coalesce(text, F.lit(""))
    lines = text
    for end in ENDS:
        lines = F.replace(lines, F.lit(end), F.lit(end + "\n"))
    heads = F.transform(F.array(*(F.substring_index(text, " ", k) for k in (1, 2, 4, 8, 16))), lambda p: F.xxhash64(p))
    return F.array_distinct(F.concat(F.transform(F.split(lines, "\n"), lambda p: F.xxhash64(p)), heads))


def _hash(d: str, salt: int) -> str:
    """SQL for the bits of a digest that place it: its own, or for a retry those of a hash of it."""
    return f"xxhash64({d}, {salt}L)" if salt else d


def _in(d: str, salt: int) -> str:
    """SQL for whether digest d goes into cell i."""
    return f"(shiftrightunsigned({_hash(d, salt)}, 4 * (i div {SLOTS})) & {SLOTS - 1}L) = i % {SLOTS}"


def _cells(of: str, salt: int = 0) -> str:
    """SQL for the cells of a short array of digests."""
    row = lambda j: f"transform(sequence(0L, {SLOTS - 1}L), i -> aggregate(filter({of}, d -> (shiftrightunsigned({_hash('d', salt)}, {4 * j}) & {SLOTS - 1}L) = i), {_ZERO}, (s, d) -> {_SUM}))"
    return f"if(size({of}) = 0, array_repeat({_ZERO}, {SLOTS * HASHES}), concat({', '.join(row(j) for j in range(HASHES))}))"


def _parts(of: str, n: str, salt: int = 0) -> str:
    """SQL for an array of digests dealt into n parts, by way of about sqrt(n) groups of them."""
    place = f"cast(pmod(shiftrightunsigned({_hash('d', salt)}, 12), {n}) AS INT)"
    keyed = f"transform({of}, d -> named_struct('d', d, 'p', {place}))"
    group = f"cast(ceil(sqrt({n})) AS INT)"
    inner = "transform(sequence(g * whole.group, least((g + 1) * whole.group, whole.n) - 1), j -> transform(filter(sub, e -> e.p = j), e -> e.d))"
    outer = f"flatten(transform(array(filter(whole.keyed, e -> e.p div whole.group = g)), sub -> {inner}))"
    each = f"flatten(transform(array(transform(sequence(0, cast(ceil(whole.n / whole.group) AS INT) - 1), g -> {outer})), of -> flatten(of)))"
    return f"flatten(transform(array(named_struct('keyed', {keyed}, 'group', {group}, 'n', {n})), whole -> {each}))"


def _peeled(cells: str, salt: int) -> str:
    """SQL for how many digests peeling recovers from the difference of two sketches; null if cells are left over.

    A round takes the digests that are alone in a cell of one row, each of which is in one cell of that row only; the rows take turns.
    """
    pure = f"filter(slice(s.cells, {SLOTS} * (r % {HASHES}) + 1, {SLOTS}), c -> abs(c.c) = 1 AND c.h = (xxhash64(c.k, 7) & 4294967295L))"
    take = f"if(c.c = 0 AND c.k = 0L, c, aggregate(filter(p, q -> {_in('q.k', salt)}), c, (c, q) -> named_struct('c', c.c - q.c, 'k', c.k ^ q.k, 'h', c.h ^ q.h)))"
    # an inner aggregate over a single element names the pure digests of this round
    step = f"aggregate(array({pure}), s, (s, p) -> if(size(p) = 0, named_struct('cells', s.cells, 'found', s.found, 'idle', s.idle + 1), named_struct('cells', transform(s.cells, (c, i) -> {take}), 'found', s.found + size(p), 'idle', 0)))"
    start = f"named_struct('cells', {cells}, 'found', 0, 'idle', 0)"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> if(s.idle < {HASHES}, {step}, s), s -> if(exists(s.cells, c -> c.c <> 0 OR c.k <> 0L OR c.h <> 0L), cast(NULL AS INT), s.found))"


def _retried(a: str, b: str) -> list[str]:
    """SQL for the number of digests that differ between two short arrays, by ever larger sketches (null: it does not peel)."""
    tries = []
    for salt, n in enumerate(LADDER[1:], 1):
        pairs = f"filter(zip_with({_parts(a, str(n), salt)}, {_parts(b, str(n), salt)}, (v1, w1) -> named_struct('a', v1, 'b', w1)), u -> size(u.a) + size(u.b) > 0)"
        cells = _MINUS.format(a=_cells("u.a", salt), b=_cells("u.b", salt))
        tries.append(f"aggregate(transform({pairs}, u -> {_peeled(cells, salt)}), 0, (sum, one) -> sum + one)")
    return tries


def n_parts(*of: str) -> Column:
    """How many parts the digests of some columns are dealt into, so that the first and the largest other have about PART in each."""
    first, *others = (F.size(c) for c in of)
    return F.greatest(F.lit(1), F.floor((first + F.greatest(*others, F.lit(0))) / PART).cast("int"))


def sketched(of: str, n: str) -> Column:
    """A digest column dealt into n parts: of each its digests d, and the cells c of its sketch."""
    return F.expr(f"transform({_parts(of, n)}, part -> named_struct('d', part, 'c', {_cells('part')}))")


def likeness(a: str, b: str, sketch_a: str, sketch_b: str) -> Column:
    """Jaccard likeness (0 to 1) of two digest columns, from their sizes and what the differences of their sketches of equally many parts give up; 1 for two empty ones.

    Null if no size of sketch peels, which takes two digests that fall together in each of len(LADDER) independent places.
    """
    cells = _MINUS.format(a="v.c", b="w.c")
    one = f"if(size(v.d) + size(w.d) = 0, 0, coalesce({', '.join([_peeled(cells, 0), *_retried('v.d', 'w.d')])}))"
    differ = F.expr(f"aggregate(zip_with({sketch_a}, {sketch_b}, (v, w) -> {one}), 0, (sum, one) -> sum + one)")
    both = F.size(a) + F.size(b)
    return F.transform(F.array(differ), lambda d: F.when(both == 0, F.lit(1.0)).otherwise(F.lit(1.0) * (both - d) / (both + d)))[0]


def sketch(of: str) -> Column:
    """The smallest sketch of a digest column: all its digests in one part."""
    return F.expr(_cells(of))


def written(cells: str, of: str) -> Column:
    """A sketch as text: the number of digests, and for each cell in use its place, count, digest and checksum, in hexadecimal."""
    used = f"filter(transform({cells}, (c, i) -> if(c.c = 0, NULL, concat(lpad(hex(i), 2, '0'), lpad(hex(c.c), 4, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.h), 8, '0')))), x -> x IS NOT NULL)"
    return F.lower(F.expr(f"concat(hex(size({of})), ':', array_join({used}, '.'))"))


def _ranged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with `cell`, first rows of each cell with `cell` of the one before): ranges of doc_id that are small groups.

    Cells are equal ranges of ids where ids are spread evenly enough; else they are ranges of ranks, for which texts are
    moved once more. Only ids are looked at.
    """
    spark = docs.sparkSession
    bounds = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high, n = bounds[0] or 0, bounds[1] or 0, bounds[2]
    width = min(max(1, -(-(high - low + 1) * RANGE_DOCS // max(n, 1))), (1 << 63) - 1)
    cell = F.floor((F.col("id").cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("long")
    placed = docs.withColumn("cell", cell)
    cells = cut(placed.select("id", "cell").groupBy("cell").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    most = cells.agg(F.max("n")).first()[0] or 0
    if most > UNEVEN * RANGE_DOCS:
        ids = cut(docs.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()))
        part = F.shiftrightunsigned("at", 33)
        sizes = sorted(ids.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
        before, total = [], 0
        for r in sizes:
            before.append((r["part"], total))
            total += r["n"]
        ranks = ids.withColumn("part", part).join(F.broadcast(spark.createDataFrame(before, "part long, before long")), "part")
        ranks = ranks.select("id", F.floor((F.col("before") + F.col("at") - F.shiftleft("part", 33)) / RANGE_DOCS).cast("long").alias("cell"))
        placed = docs.join(ranks, "id")
        cells = cut(ranks.groupBy("cell").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    # the cell before each: within runs of cells by a window, between runs by a short list
    run = F.floor(F.col("cell") / 4096)
    ends = sorted(cells.groupBy(run.alias("run")).agg(F.max("cell").alias("last")).collect())
    before = [(ends[k]["run"], ends[k - 1]["last"]) for k in range(len(ends))]
    known = spark.createDataFrame(before, "run long, last long")
    heads = cells.withColumn("run", run).join(F.broadcast(known), "run")
    heads = heads.select("first", F.coalesce(F.lag("cell").over(Window.partitionBy("run").orderBy("cell")), "last").alias("cell"))
    return placed, F.broadcast(heads) if n <= RANGE_DOCS * 1_000_000 else heads


def fingerprints(docs: DataFrame) -> DataFrame:
    """A fingerprint of each text and of its edited text (their smallest sketches), and what sketches say about versions.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The edited text has
    the first floor(n_chars / 2) code points of the next document, or all it has, in place of its own last ones. The next document is
    the one with the next doc_id, that of the last the first; a single document is its own. Null texts are empty; a null
    doc_id comes first; rows repeated with one doc_id follow each other in order of text. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed, heads = _ranged(rows)
    base = placed.select("doc_id", "id", "text", "cell", F.lit(False).alias("copy"))
    firsts = rows.join(heads, rows["id"] == heads["first"]).select("doc_id", "id", "text", "cell", F.lit(True).alias("copy"))
    order = Window.partitionBy("cell").orderBy("copy", "id", "text")
    both = base.unionAll(firsts).withColumn("d", digests(F.col("text")))  # once for each text, though it is also the next of another
    with_next = both.withColumns({"next": F.lead("text").over(order), "x": F.lead("d").over(order)}).where("NOT copy")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    texts = with_next.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "d", "x")
    sets = texts.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "d", digests(F.col("edited")).alias("e"), "x")
    dealt = sets.withColumn("n", n_parts("d", "e", "x"))
    cells = dealt.withColumns({"pd": sketched("d", "n"), "pe": sketched("e", "n"), "px": sketched("x", "n"), "sd": sketch("d"), "se": sketch("e")})
    return cells.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written("sd", "d").alias("fingerprint"),
        written("se", "e").alias("edited_fingerprint"),
        likeness("d", "e", "pd", "pe").alias("near_edited"),
        likeness("d", "x", "pd", "px").alias("near_next"),
    )
