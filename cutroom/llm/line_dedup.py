"""Line dedup over all documents by a deletion-neighbourhood join, with DataFrame functions only.

A line is dropped if the same line stands earlier (by doc_id, then line), or one within one edit (a
character put in, taken out or replaced). Equal lines are grouped by hash. For the others:

1. Within one edit, either the first or the last half of both lines is the same. Lines that share no half
   with another line are done.
2. The rest are seen as blocks of BLOCK characters: lines that agree before and after a block can differ
   by one edit in it only. Blocks whose surroundings no other line has are done.
3. The deletion neighbourhood: all variants of the block with one character taken out become hashed keys,
   with what surrounds the block. Lines with equal variants at the same place are within one replacement;
   a variant that equals another line's whole block is one character short of it. The Levenshtein
   distance of the blocks is verified, and all but the earliest line are dropped.

A group of equal variants at one place has at most as many lines as there are characters, so no group
grows with the data; counts and minima are made before rows are shuffled. Lines are shuffled by their hashes;
texts are read again, and only those of lines that share a half with another are shuffled.

Lines are compared after trimming white space. Blank lines and null texts have nothing to compare and
stay. Lines of any length are compared, however short; `min_chars` leaves shorter ones to be compared for
equality only, where a caller wants that. Rows that repeat doc_id and text are one document. A null doc_id
comes first in order. An empty table gives no rows. A very long text is split in one task, and put together
again in time proportional to its lines. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import Shelf, apart, original

BLOCK = 32
#: Characters beyond which a line's surroundings are put together from hashes of its blocks.
LONG = 1024

_line = ["h1", "h2"]
_document = ["k1", "k2"]


def _text() -> Column:
    return F.col("text").cast("string")


def _trimmed(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))


def _documents(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", _text().alias("text"), F.xxhash64("doc_id", _text()).alias("k1"), F.hash(_text()).alias("k2"))
    return rows.withColumn("lines", _trimmed(F.split("text", "\n", -1)))


def _lines(docs: DataFrame) -> DataFrame:
    """k1, k2, order (doc_id, line_no, k1), line, h1, h2 of every line that is not blank."""
    rows = _documents(docs).select("doc_id", *_document, F.posexplode("lines").alias("line_no", "line")).filter("line <> ''")
    order = F.struct("doc_id", "line_no", "k1").alias("order")
    return rows.select(*_document, order, "line", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def _left(size: Column) -> Column:
    return F.substr(F.col("line"), F.lit(1), size)


def _right(size: Column) -> Column:
    return F.when(size > 0, F.substr(F.col("line"), F.char_length("line") - size + 1, size)).otherwise("")


def _halves() -> Column:
    """Keys of the halves by which a line meets one as long or longer, and one that is shorter."""
    n = F.char_length("line")
    sizes = [F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")]
    return F.array_distinct(F.array(*(F.xxhash64(F.lit(tag), m, side(m)) for m in sizes for tag, side in (("left", _left), ("right", _right)))))


def _blocks() -> Column:
    """Of each block, seen as itself (role 0) and as one character longer than another line's (role 1): key of its place and surroundings, and the block. Of a line up to LONG: the surroundings are hashed whole for each block."""
    n = F.char_length("line")
    none = F.array().cast("array<struct<role:int,place:bigint,block:string>>")

    def block(role: int) -> Column:
        base = n - role
        begin = lambda j: j * BLOCK
        after = lambda j: F.greatest(F.lit(0), base - (j + 1) * BLOCK)
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(base / BLOCK).cast("int")),
            lambda j: F.struct(
                F.lit(role).alias("role"),
                F.xxhash64(j, base, _left(begin(j)), _right(after(j))).alias("place"),
                F.substr(F.col("line"), begin(j) + 1, n - begin(j) - after(j)).alias("block"),
            ),
        )
        return F.when(base <= LONG, blocks).otherwise(none)

    return F.concat(block(0), block(1))


def _long_blocks(lines: DataFrame) -> DataFrame:
    """h1, h2, order, role, place, block as of _blocks(), of lines beyond LONG, in time proportional to their length.

    A line is cut in blocks once, each a row; a block's surroundings are the exclusive or of the hashes of the blocks
    around it, each with its number. Blocks after it begin a character later if the line has one more (role 1). Lines
    that are compared have the same length but for the role, so a place is made in one way on both sides.
    """
    n = F.char_length("line")
    cut = lambda text: F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    own = F.concat(cut(F.col("line")), F.when(n % BLOCK == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    parts = lines.filter(n > LONG).select(*_line, "order", n.alias("n"), F.posexplode(F.arrays_zip(own.alias("own"), cut(F.substr(F.col("line"), F.lit(2))).alias("after"))).alias("j", "part"))
    rows = parts.select(*_line, "order", "n", "j", "part.*")
    by, back = (Window.partitionBy(*_line).orderBy(order) for order in ("j", F.desc("j")))  # frames that grow row by row
    others = lambda c, window: F.coalesce(F.bit_xor(F.when(F.col(c) != "", F.xxhash64("j", c))).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"before": others("own", by), "rest0": others("own", back), "rest1": others("after", back), "next": F.coalesce(F.lead("own").over(by), F.lit(""))})
    place = lambda role: F.xxhash64("j", F.col("n") - role, "before", f"rest{role}")
    one = lambda role, block: F.when((F.col("n") - role > LONG) & (F.col("j") <= F.floor((F.col("n") - role) / BLOCK)), F.struct(F.lit(role).alias("role"), place(role).alias("place"), block.alias("block")))
    both = F.array_compact(F.array(one(0, F.col("own")), one(1, F.concat("own", F.substr(F.col("next"), F.lit(1), F.lit(1))))))
    return rows.select(*_line, "order", F.explode(both).alias("b")).select(*_line, "order", "b.*")


def _variants() -> Column:
    """Keys of a block's variants: `replaced` with the place of the gap; `whole` the block itself, or what it is once a character is out."""
    gaps = F.sequence(F.lit(1), F.char_length("block"))
    without = lambda i: F.concat(F.substr(F.col("block"), F.lit(1), i - 1), F.substr(F.col("block"), i + 1, F.lit(BLOCK + 1)))
    key = lambda kind, i, text: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), F.col("place"), i, text).alias("variant"))
    some = F.char_length("block") > 0
    none = F.array().cast("array<struct<kind:string,variant:bigint>>")
    replaced = F.when(some, F.transform(gaps, lambda i: key("replaced", i, without(i)))).otherwise(none)
    shorter = F.when(some, F.array_distinct(F.transform(gaps, lambda i: key("whole", F.lit(0), without(i))))).otherwise(none)
    return F.when(F.col("role") == 0, F.concat(replaced, F.array(key("whole", F.lit(0), F.col("block"))))).otherwise(shorter)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """rows whose key stands in another row too."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("__n")).filter("__n > 1").select(key), key, "left_semi")


def _keys(lines: DataFrame, min_chars: int) -> DataFrame:
    """k1, k2, order, h1, h2, n_chars and halves (null of lines under min_chars) of each line: what is grouped and joined instead of texts."""
    n = F.char_length("line")
    return lines.select(*_document, "order", *_line, n.alias("n_chars"), F.when(n >= min_chars, _halves()).alias("halves"))


def _likely(lines: DataFrame, keys: DataFrame, shelf: Shelf) -> DataFrame:
    """h1, h2, line and order (the first place) of each distinct line that shares a half with another, and of few others."""
    halves = keys.select("h1", F.explode("halves").alias("half"))
    shared = shelf.put(halves.groupBy("half").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).filter("least < most").select("half"))
    own = F.col("h1")
    likely = shelf.put(apart(halves, F.col("half"), shared, F.col("half"))[1].join(shared, "half", "left_semi").select("h1").distinct())
    texts = shelf.put(apart(lines, own, likely, own)[1].groupBy(*_line).agg(F.min("order").alias("order"), F.first("line").alias("line")))
    shelf.free(shared, likely)
    return texts


def near_lines(lines: DataFrame, keys: DataFrame, shelf: Shelf) -> DataFrame:
    """(h1, h2) of distinct lines with an earlier line within one edit, and the earliest such (by). keys: of lines, by _keys()."""
    texts = _likely(lines, keys, shelf)
    short = texts.filter(F.char_length("line") <= LONG + 1).select(*_line, "order", F.explode(_blocks()).alias("b")).select(*_line, "order", "b.*")
    blocks = shelf.put(short.union(_long_blocks(texts)))
    variants = shelf.put(_shared(blocks, "place").select(*_line, "order", "role", "block", F.explode(_variants()).alias("v")).select(*_line, "order", "role", "block", "v.*"))
    within = F.levenshtein("block", "other") <= 1

    replaced = variants.filter("kind = 'replaced'")
    earliest = replaced.groupBy("variant").agg(F.min(F.struct("order", F.col("block").alias("other"))).alias("e"), F.count("*").alias("n")).filter("n > 1")
    a = replaced.join(earliest, "variant").select(*_line, "order", "block", F.col("e.order").alias("by"), F.col("e.other").alias("other"))

    whole = variants.filter("kind = 'whole'")
    same, longer = (whole.filter(f"role = {r}").select("variant", *(F.col(c).alias(f"{c}_{r}") for c in (*_line, "order", "block"))) for r in (0, 1))
    met = same.join(longer, "variant")
    sides = [met.select(*(F.col(f"{c}_{r}").alias(c) for c in (*_line, "order", "block")), F.col(f"order_{1 - r}").alias("by"), F.col(f"block_{1 - r}").alias("other")) for r in (0, 1)]

    found = a.union(sides[0]).union(sides[1]).filter((F.col("by") < F.col("order")) & within)
    near = shelf.put(found.groupBy(*_line).agg(F.min("by").alias("by")))
    shelf.free(texts, blocks, variants)
    return near


def dropped_lines(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """k1, k2, line_no, n_chars, reason (`exact` or `near`) and kept_doc, kept_line (where the earlier line stands) of each dropped line, once a document."""
    shelf = Shelf(docs.sparkSession)
    lines = _lines(docs)
    keys = shelf.put(_keys(lines, min_chars))
    near = near_lines(lines, keys, shelf)
    first = keys.groupBy(*_line).agg(F.min("order").alias("first"), F.count("*").alias("n"))
    # written first, so that the join's inputs are shuffles alone, which AQE splits where a line is frequent
    verdict = shelf.put(first.join(near, _line, "left").filter("n > 1 OR by IS NOT NULL").select(*_line, "first", "by"))
    rows = apart(keys.drop("halves"), F.col("h1"), verdict, F.col("h1"))[1].join(verdict, _line)
    exact = F.col("first") < F.col("order")
    rows = rows.filter(exact | F.col("by").isNotNull())
    kept = F.coalesce("by", "first")
    out = shelf.put(rows.select(*_document, F.col("order.line_no").alias("line_no"), "n_chars", F.when(exact, "exact").otherwise("near").alias("reason"), kept["doc_id"].alias("kept_doc"), kept["line_no"].alias("kept_line")).dropDuplicates([*_document, "line_no"]))
    shelf.free(keys, near, verdict)
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """docs with the dropped lines gone from text (null stays null); all columns."""
    gone = dropped_lines(docs, min_chars).groupBy(*_document).agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    at = docs.columns.index("text")
    named = docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))
    text = F.col(f"__{at}").cast("string")
    rows = named.withColumns({"k1": F.xxhash64(f"__{docs.columns.index('doc_id')}", text), "k2": F.hash(text)}).join(gone, _document, "left")
    lines = F.split(text, "\n", -1)
    # the lines between two that go, as one slice each
    between = F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array(F.size(lines))), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return original(rows.withColumn(f"__{at}", F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.flatten(between), "\n"))), docs)


def digest(docs: DataFrame, min_chars: int = 0) -> DataFrame:
    """doc_id, n_lines (not blank), n_chars (of those, trimmed), and of the dropped: n_exact, n_near, dropped_chars."""
    some = F.filter("lines", lambda x: x != "")
    rows = _documents(docs).select("doc_id", *_document, F.coalesce(F.size(some), F.lit(0)).alias("n_lines"), F.coalesce(F.aggregate(F.transform(some, lambda x: F.char_length(x)), F.lit(0), lambda a, b: a + b), F.lit(0)).alias("n_chars"))
    rows = rows.withColumn("n_lines", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")))
    gone = dropped_lines(docs, min_chars).groupBy(*_document).agg(F.count_if(F.col("reason") == "exact").alias("n_exact"), F.count_if(F.col("reason") == "near").alias("n_near"), F.sum("n_chars").alias("dropped_chars"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.join(gone, _document, "left").select("doc_id", *(count(c) for c in ("n_lines", "n_chars", "n_exact", "n_near", "dropped_chars")))
