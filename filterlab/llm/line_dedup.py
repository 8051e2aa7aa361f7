"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

Lines that hold a letter or a digit take part; others are layout and stay. Two lines are copies if
the Jaccard similarity of their sets of ``SHINGLE``-character shingles is at least ``SIMILARITY``
(a shorter line is a shingle by itself, so it is a copy of equal lines only); copies of copies form a
component, of which one line stays, the one with the least (doc_id, hash of the text, position).

1. Each line gets 16 minima: shingle hashes, XORed with 16 masks that look into different ranges of
   the hash space. Shingles are hashed where the line is read; equal lines share their minima, so the
   aggregate that makes the minima collapses them before its shuffle.
2. Banding: the 16 minima lie on a 4 x 4 grid, and bands are its rows, columns and three classes of
   diagonals, 20 bands of 4 of which no two share more than one minimum. Lines of similarity 0.8
   share a band in 99.5 % of cases, of 0.85 in 99.91 %, of 0.9 in 99.99 %.
3. Exact verification and union-find in rounds. In each round every band has leaders (one in the first
   round, ``LEADERS`` then) that all its other lines are compared with, unless they are connected
   already; then the leaders leave the band, since no pair with one of them is open. Components are contracted between rounds, so a group of m near
   copies is connected by some m comparisons for each band, not m * m. When rounds stop to connect
   much, the pairs still open (lines of one band in different components) are compared all at once.
4. From the second round on a pair is read in full only if sketches don't prove it too different:
   shingle sets are XORed into 2,048 bits, common shingles cancel, so the bits that two sketches
   differ in are a lower bound of their sets' symmetric difference. Lines of a band meet with sketches folded into
   1,024 bits, which bound it too; the pairs left are looked at with whole ones.

Null texts and rows with a null doc_id are left as they are. A row is known by its id and a hash of its text, so each
text of an id that several rows share keeps its own lines; rows alike in both are one document, and lose the same
lines. Ids of any type that can be ordered do, fractions included. An empty table gives an empty result. Lines
are told apart by 96 bits of two hashes, shingles by 64.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window as W

from filterlab.llm.common import forget, stored
from filterlab.llm.graph import components

SHINGLE, SIMILARITY = 8, 0.8
GRID = 4
#: Shingles that meet the minima of their line together, in one row.
PER_ROW = 4
#: A band is hot if it holds at least one of HOT_SHARE sampled lines, and HOT_SAMPLES of them; one line of SAMPLED is in the sample.
HOT_SHARE, HOT_SAMPLES, SAMPLED = 1_000, 20, 256
#: Words of 64 bits in a sketch.
SKETCH_WORDS = 32
#: Words that a sketch is folded into for a first look: few enough that the code of a comparison is compiled.
FOLDED_WORDS = 16
#: A round of leaders is followed by another while it connects at least this share of the open rows.
WORTH_A_ROUND = 0.01
#: Leaders of a band in each round but the first.
LEADERS = 8
#: Lines of a band that one part of its last comparison takes, comparisons of a task, and tasks at most.
PART, PART_PAIRS, MAX_TASKS = 512, 2_000_000, 20_000
#: Keys that are broadcast at most (8 bytes each, some 40 in a hash table).
BROADCAST_KEYS = 500_000


def _masks() -> list[int]:
    """XOR masks, one for each sixteenth of the hash space; the lower bits are of no matter."""
    return [(((k * 0x9E3779B97F4A7C15) & ((1 << 60) - 1)) | (k << 60)) - ((1 << 64) if k >= 8 else 0) for k in range(GRID * GRID)]


def _bands() -> list[list[int]]:
    rows = [[GRID * r + c for c in range(GRID)] for r in range(GRID)]
    columns = [[GRID * r + c for r in range(GRID)] for c in range(GRID)]
    # three sets of diagonals, from the orthogonal Latin squares of order 4: no two of all bands share two places
    square = [[0, 1, 2, 3], [1, 0, 3, 2], [2, 3, 0, 1], [3, 2, 1, 0]]
    turned = [[square[k] for k in order] for order in ((0, 1, 2, 3), (0, 2, 3, 1), (0, 3, 1, 2))]
    diagonals = [[GRID * r + q[r][c] for r in range(GRID)] for q in turned for c in range(GRID)]
    return rows + columns + diagonals


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, base, pos, line, key, check of the lines that take part; row: a hash of the text; base: a number for id and
    row, in order of both, that leaves room for positions (null if ids aren't whole numbers)."""
    have = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).withColumn("__row", F.xxhash64(text_col))
    base = F.lit(None).cast("decimal(38,0)")
    if isinstance(docs.schema[id_col].dataType, IntegralType):  # 19 digits of id, 9 of hash, 10 of position
        of_row = F.col(id_col).cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + F.pmod("__row", F.lit(10**9))
        base = (of_row.cast("decimal(28,0)") * F.lit(1 << 31).cast("decimal(10,0)")).cast("decimal(38,0)")
    lines = have.select(F.col(id_col).alias("doc_id"), F.col("__row").alias("row"), base.alias("base"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return lines.where(F.rlike("line", F.lit(r"[\p{L}\p{N}]"))).withColumns({"key": F.xxhash64("line"), "check": F.hash("line")})


def _wide(line: Column) -> Column:
    return F.encode(line, "UTF-32")  # four bytes for each code point: shingles are cut in no time


def shingles(line: Column) -> Column:
    """The set of a line's shingles, each by its 64-bit hash."""
    places = F.sequence(F.lit(1), 4 * F.greatest(F.length(line) - SHINGLE, F.lit(0)) + 1, F.lit(4))  # bytes of the wide form
    # the wide form is bound as a lambda's variable: written into the inner lambda, it would be made for each shingle.
    # Lambdas are interpreted, so they hold no more than they must
    hashes = F.transform(F.array(_wide(line)), lambda wide: F.transform(places, lambda at: F.xxhash64(F.substring(wide, at, F.lit(4 * SHINGLE)))))
    return F.array_distinct(F.element_at(hashes, 1))


def signatures(lines: DataFrame) -> DataFrame:
    """key, m0 .. m15: the minima of every distinct line that has a whole shingle."""
    wide = lines.select("key", _wide(F.col("line")).alias("wide"))
    wide = wide.select("key", "wide", (F.octet_length("wide") - (4 * SHINGLE - 1)).alias("last"))  # places count bytes, from 1
    places = F.when(F.col("last") > 0, F.sequence(F.lit(1), "last", F.lit(4 * PER_ROW)))
    cut = wide.select("key", "wide", "last", F.explode(places).alias("at"))
    # the last row of a line names its last shingle repeatedly, which no minimum minds
    hashes = [F.xxhash64(F.substring("wide", F.least(F.col("at") + 4 * j, "last"), F.lit(4 * SHINGLE))).alias(f"h{j}") for j in range(PER_ROW)]
    least = [F.min(F.least(*(F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(PER_ROW)))) for m in _masks()]
    return cut.select("key", *hashes).groupBy("key").agg(*(m.alias(f"m{k}") for k, m in enumerate(least)))


def band_members(lines: DataFrame) -> DataFrame:
    """band, key, least: the lines of every band that holds more than one, and its least.

    A window finds the least and the greatest line of a band, which puts a band in one task. Bands that are likely to hold
    1 / HOT_SHARE of all lines or more, by a sample of the keys, are aggregated instead (combined before the shuffle) and
    joined with a broadcast table of at most 20 * HOT_SHARE rows. The sample only chooses the way; both give the same rows."""
    bands = F.array(*(F.xxhash64(F.lit(k), *(F.col(f"m{i}") for i in band)) for k, band in enumerate(_bands())))
    minima = stored(signatures(lines), "line-minima", plain=True)
    banded = minima.select("key", F.explode(bands).alias("band"))
    sample = minima.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SAMPLED)) == 0)
    enough = max(HOT_SAMPLES, sample.count() // HOT_SHARE)
    hot = sample.select(F.explode(bands).alias("at")).groupBy("at").count().where(F.col("count") >= enough).select("at")
    hot = stored(hot.coalesce(1), "line-hot")
    every = W.partitionBy("band")
    cool = banded
    if any_hot := hot.count() > 0:
        cool = banded.join(F.broadcast(hot), F.col("band") == F.col("at"), "left_anti")
    cool = cool.withColumn("least", F.min("key").over(every)).withColumn("most", F.max("key").over(every))
    members = cool.where("least < most").select("band", "key", "least")
    if any_hot:
        warm = banded.join(F.broadcast(hot), F.col("band") == F.col("at"), "left_semi")
        least = stored(warm.groupBy(F.col("band").alias("at")).agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").drop("most"), "line-hot-bounds")
        members = members.unionAll(banded.join(F.broadcast(least), F.col("band") == F.col("at")).select("band", "key", "least"))
    return members


def sketches(texts: DataFrame) -> DataFrame:
    """key, n, x0, x1 ..: the size of each line's shingle set and the set XORed into SKETCH_WORDS words."""
    each = texts.select("key", F.explode(shingles(F.col("line"))).alias("h"))
    place = F.pmod(F.shiftrightunsigned("h", 8), F.lit(SKETCH_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    words = each.groupBy("key", place.alias("word")).agg(F.count("*").alias("n"), F.bit_xor(bit).alias("x"))
    zero = F.lit(0).cast("bigint")
    return words.groupBy("key").agg(F.sum("n").alias("n"), *(F.max(F.when(F.col("word") == k, F.col("x"))).alias(f"x{k}") for k in range(SKETCH_WORDS))).select("key", "n", *(F.coalesce(f"x{k}", zero).alias(f"x{k}") for k in range(SKETCH_WORDS)))


def folded(sketched: DataFrame) -> DataFrame:
    """key, n, x0, x1 ..: sketches XORed into FOLDED_WORDS words, which bound the symmetric difference too, if less closely."""
    words = [reduce(Column.bitwiseXOR, (F.col(f"x{j}") for j in range(k, SKETCH_WORDS, FOLDED_WORDS))) for k in range(FOLDED_WORDS)]
    return sketched.select("key", "n", *(w.alias(f"x{k}") for k, w in enumerate(words)))


def may_match(one: str, other: str, words: int = SKETCH_WORDS) -> Column:
    """Whether two sketched sets can be similar enough; their columns end in one and other.
    J >= s just if the symmetric difference is at most (1 - s) / (1 + s) of the sizes' sum."""
    differing = sum((F.bit_count(F.col(f"x{k}{one}").bitwiseXOR(F.col(f"x{k}{other}"))) for k in range(words)), F.lit(0))
    gap = F.abs(F.col(f"n{one}") - F.col(f"n{other}"))
    return F.greatest(differing, gap) * F.lit(1 + SIMILARITY) <= F.lit(1 - SIMILARITY) * (F.col(f"n{one}") + F.col(f"n{other}")) + F.lit(1e-6)


def closer(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose whole sketches may match."""
    both = pairs.join(suffixed(sketched, "_a", key="a"), "a").join(suffixed(sketched, "_b", key="b"), "b")
    return both.where(may_match("_a", "_b")).select("a", "b")


def suffixed(sketched: DataFrame, end: str, **names: str) -> DataFrame:
    """The columns of sketches renamed with an end, and others as names say."""
    return sketched.select(*(F.col(c).alias(names.get(c, c + end)) for c in sketched.columns))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose lines are similar enough. The sets of lines b, of which there are fewer
    than pairs, are made before they meet their pairs."""
    left = texts.select(F.col("key").alias("a"), F.col("line").alias("line_a"))
    right = texts.join(pairs.select(F.col("b").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("b"), shingles(F.col("line")).alias("y"))
    # a set is no larger than its line has places for shingles, and similar sets are nearly of a size
    # by merge: Spark sizes a set like one shingle, and would broadcast sets
    near = pairs.join(left, "a").join(right.hint("merge"), "b").where(F.greatest(F.length("line_a") - (SHINGLE - 1), F.lit(1)) >= SIMILARITY * F.size("y"))
    # exploded from an array of one, the set is made once: a filter below a projection has its columns written out in it
    sets = near.select("a", "b", F.explode(F.array(shingles(F.col("line_a")))).alias("x"), "y")
    nx, ny, both = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    sets = sets.where(F.least(nx, ny) >= SIMILARITY * F.greatest(nx, ny))
    # both >= SIMILARITY * (nx + ny - both), with both, which is costly, once
    return sets.where(both * (1 + SIMILARITY) + 1e-6 >= SIMILARITY * (nx + ny)).select("a", "b")


def still_open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """band, key, root of the rows (band, key) whose band holds lines of more than one component; a stored table."""
    named = stored(rows.join(roots, F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("root", "key").alias("root")), "line-named")
    mixed = named.groupBy(F.col("band").alias("at")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("at")
    found = stored(named.join(mixed, F.col("band") == F.col("at"), "left_semi"), "line-open")
    forget(named)
    return found


def unsettled_pairs(rows: DataFrame) -> DataFrame:
    """a, b: the pairs of one band, but different roots, of the rows with folded sketches (band, key, root, n, x0 ..) that
    may match. A band of m lines takes m * m comparisons, so it is cut into parts of some PART lines: each part, a row
    of tasks' own, meets the whole band. Tasks are counted by comparisons, not by bytes: rows are few and pairs many."""
    sizes = stored(rows.groupBy("band").agg(F.count("*").alias("m")).select(F.col("band").alias("at"), "m", F.ceil(F.col("m") / PART).cast("int").alias("parts")), "line-sizes")
    work = sizes.agg(F.sum(F.col("m").cast("double") * F.col("m"))).first()[0] or 0
    tasks = int(min(max(work / PART_PAIRS, 1), MAX_TASKS))
    cut = rows.join(sizes, F.col("band") == F.col("at")).drop("at", "m")
    one = cut.withColumn("part", F.pmod(F.xxhash64("key", F.lit(0)), F.col("parts"))).drop("parts").withColumnRenamed("band", "band_a").withColumnRenamed("part", "part_a")
    every = cut.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))).drop("parts")
    other = suffixed(every, "_b", band="band", part="part", key="b").repartition(tasks, "band", "part")
    met = (F.col("band_a") == F.col("band")) & (F.col("part_a") == F.col("part")) & (F.col("root") < F.col("root_b")) & may_match("", "_b", FOLDED_WORDS)
    pairs = one.repartition(tasks, "band_a", "part_a").join(other.hint("merge"), met)
    return pairs.select(F.col("key").alias("a"), "b").distinct()


def rooted(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """node, node_check, root of each line (key, line), which is its own root if roots don't name it. Lines are hashed
    before the join, so that none is shuffled for its hash."""
    checks = texts.select("key", F.hash("line").alias("node_check"))
    return checks.join(roots, F.col("key") == F.col("node"), "left").select(F.col("key").alias("node"), "node_check", F.coalesce("root", "key").alias("root"))


def line_components(lines: DataFrame) -> DataFrame:
    """node, node_check, root: key, check and component of the lines (key, line) that share a band with others."""
    members = stored(band_members(lines), "line-bands")
    wanted = stored(members.select("key").distinct(), "line-members")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    texts = stored(lines.join(few, "key", "left_semi").groupBy("key").agg(F.min("line").alias("line")), "line-texts")
    pairs = stored(members.where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")).distinct(), "line-pairs")
    roots = components(verified(pairs, texts))
    # the leaders of the first round were compared with all others of their bands
    rows = still_open(members.where("key <> least").select("band", "key"), roots)
    forget(members, wanted, pairs)
    sketched = stored(sketches(texts.join(rows.select("key").distinct(), "key", "left_semi")), "line-sketches")
    short = stored(folded(sketched), "line-folded")
    turn, n_open = 0, rows.count()
    while n_open:
        turn += 1
        # leaders by hashes of their own for each band: an XOR with one keeps the key in the minimum
        salts = [F.xxhash64("band", F.lit(turn), F.lit(k)) for k in range(LEADERS)]
        first = rows.groupBy("band").agg(*(F.min(F.col("key").bitwiseXOR(salt)).alias(f"l{k}") for k, salt in enumerate(salts)))
        first = first.select(F.col("band").alias("at"), F.array_distinct(F.array(*(F.col(f"l{k}").bitwiseXOR(salt) for k, salt in enumerate(salts)))).alias("leaders"))
        led = stored(rows.join(short, "key").join(first, F.col("band") == F.col("at")).drop("at"), "line-led")
        heads = suffixed(led.where(F.array_contains("leaders", F.col("key"))).drop("leaders"), "_b", band="at", key="b", root="head")
        once = ~F.array_contains("leaders", F.col("key")) | (F.col("key") < F.col("b"))  # of two leaders, one meets the other
        met = led.join(heads, (F.col("band") == F.col("at")) & (F.col("root") != F.col("head")) & once & may_match("", "_b", FOLDED_WORDS))
        pairs = stored(closer(met.select(F.col("key").alias("a"), "b").distinct(), sketched), "line-pairs")
        links = stored(verified(pairs, texts), "line-links")
        found, before = links.count(), rows
        if found:
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links))
        rows = still_open(led.where(~F.array_contains("leaders", F.col("key"))).select("band", "key"), roots)
        forget(before, led, pairs, links)
        if found < WORTH_A_ROUND * n_open:
            break
        n_open = rows.count()
    rows = stored(rows.join(short, "key"), "line-unsettled")
    rest = stored(closer(unsettled_pairs(rows), sketched), "line-pairs")
    links = stored(verified(rest, texts), "line-links")
    if links.count():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links))
    nodes = stored(rooted(texts, roots), "line-nodes")
    forget(rows, sketched, short, texts, rest, links)
    return nodes


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, dropped: the positions (from 0, in order) of the lines that a copy stands in for, for each row's id and
    hash of the text; rows that lose none are left out."""
    lines = lines_of(docs, id_col, text_col)
    nodes = line_components(lines.select("key", "line"))
    place = F.struct("doc_id", "row", "pos")
    if isinstance(docs.schema[id_col].dataType, IntegralType):  # one number is compared faster
        place = (F.col("base") + F.col("pos")).cast("decimal(38,0)")
    at = stored(lines.select("key", "check", "doc_id", "row", "pos", place.alias("place")), "line-places")
    by_line = at.groupBy("key", "check").agg(F.min("place").alias("place"), F.max("place").alias("last"))
    by_line = by_line.join(nodes, (F.col("key") == F.col("node")) & (F.col("check") == F.col("node_check")), "left").where("root IS NOT NULL OR place < last")
    # a line without near copies is a component by itself; its check tells it from another line of its key
    by_line = stored(by_line.select("key", "check", "place", "last", F.coalesce("root", "key").alias("root"), F.when(F.col("root").isNull(), F.col("check")).alias("alone")), "line-roots")
    kept = by_line.groupBy("root", "alone").agg(F.min("place").alias("kept"), F.max("last").alias("last")).where("kept < last")
    kept = kept.select(F.col("root").alias("r"), F.col("alone").alias("l"), "kept")
    # by merge: in memory its rows are several times what their files are, by which Spark would broadcast them
    by_line = by_line.hint("merge").join(kept, (F.col("root") == F.col("r")) & F.col("alone").eqNullSafe(F.col("l"))).select("key", "check", "kept")
    gone = at.join(by_line, ["key", "check"]).where("place <> kept")
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_kept, dropped of every row of docs (no lines in a null text)."""
    gone = dropped_lines(docs, id_col, text_col).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "dropped")
    n = F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1
    counts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    joined = counts.join(gone, (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r")), "left").withColumn("dropped", F.coalesce("dropped", none))
    return joined.select("doc_id", "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), "dropped")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, in its own columns, without the dropped lines."""
    gone = dropped_lines(docs, id_col, text_col).select(F.col("doc_id").alias("__line_doc"), F.col("row").alias("__line_row"), F.col("dropped").alias("__line_dropped"))
    parts = F.split(text_col, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__line_dropped"))
    text = F.when(F.col("__line_dropped").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(parts, i + 1)), "\n"))
    joined = docs.join(gone, (F.col(id_col) == F.col("__line_doc")) & (F.xxhash64(text_col) == F.col("__line_row")), "left")
    return joined.withColumn(text_col, text).select(*docs.columns)
