"""Line dedup by winnowing over line hashes (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Tables, sieve, sifted

#: A line ends at a new line, or at a sentence's end inside one: passages are often put into the middle of lines.
LINE_END = r"(?<=\n)|(?<=[.!?] )"
#: The same ends with what is left out when lines are only compared, and what ends a text without a line behind it.
_GAP, _END = r" (?<=[.!?] )|\n", r"\n|[.!?] "
#: Stands for a line's end while a text is split; a text that has it itself is split by the pattern, more slowly.
_CUT = "\ue000"
_BLANK = " \n\t\r\x0b\x0c"
_FAR = (1 << 63) - 1
#: Lines of fewer words are chosen as fingerprints only where a window has no longer one: short lines are common.
LONG_LINE = 8


def _marked(text: Column) -> Column:
    for end in ("\n", ". ", "! ", "? "):
        text = F.replace(text, F.lit(end), F.lit(end + _CUT))
    return text


def _lines(text: Column) -> Column:
    return F.filter(F.when(F.contains(text, F.lit(_CUT)), F.split(text, LINE_END)).otherwise(F.split(_marked(text), _CUT)), lambda x: x != "")


def _ended(text: Column) -> Column:
    return reduce(or_, (F.endswith(text, F.lit(x)) for x in ("\n", ". ", "! ", "? ")))


def _n_lines(text: Column) -> Column:
    """Number of lines, counted by their ends."""
    return F.coalesce(F.regexp_count(text, F.lit(_END)) + F.when(_ended(text) | (text == ""), 0).otherwise(1), F.lit(0)).cast("long")


def _order(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(_FAR)).alias("doc"), F.xxhash64(text).alias("row")]


def line_table(docs: DataFrame) -> DataFrame:
    """Each row's lines: (doc, row, n_lines, at, h, n), all lines' number, and the places, hashes and words of those
    that aren't blank. ``at`` is null where no line is blank."""
    t = F.col("t")
    has = lambda *parts: reduce(or_, (F.contains(t, F.lit(x)) for x in parts))
    d = docs.where("text is not null and text <> ''").select(*_order(), F.col("text").alias("t"))
    # where blanks are single spaces, a line has a word more than it has blanks; so in nearly all texts, and cheaper
    d = d.withColumn("plain", ~has("\t", "\x0b", "\x0c", "\r", "  "))
    # the ends are split off here, which leaves an empty piece behind the last one
    d = d.withColumn("pieces", F.when(F.col("plain"), F.transform(F.split("t", _GAP), lambda x: F.btrim(x))).otherwise(F.transform(_lines(t), lambda x: F.btrim(x, F.lit(_BLANK)))))
    d = d.withColumn("u", F.when(F.col("plain") & _ended(t), F.slice("pieces", 1, F.size("pieces") - 1)).otherwise(F.col("pieces")))
    d = d.select("doc", "row", "plain", "u").withColumn("n_lines", F.size("u")).where("n_lines > 0")
    d = d.withColumn("at", F.when(F.array_contains("u", F.lit("")), F.expr("filter(sequence(0, n_lines - 1), i -> u[i] != '')")))
    d = d.withColumn("u", F.when(F.col("at").isNotNull(), F.array_remove("u", F.lit(""))).otherwise(F.col("u")))
    spaces = F.transform("u", lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    counted = F.transform("u", lambda x: F.regexp_count(x, F.lit(WORD)))
    return d.select("doc", "row", "n_lines", "at", F.transform("u", lambda x: F.xxhash64(x)).alias("h"), F.when(F.col("plain"), spaces).otherwise(counted).alias("n"))


def _steps(d: DataFrame, at: str, sign: int, min_words: int) -> DataFrame:
    """Column ``at`` (a place) moved as far ahead or back as the words of the lines left behind stay below
    ``min_words``, and those words as ``at``_words. Steps of 2**k lines are tried, largest first; sums that reach
    beyond the text are null and never taken."""
    words = f"{at}_words"
    d = d.withColumn(words, F.lit(0))
    for k in range((min_words - 1).bit_length() - 1, -1, -1):
        sum_at = F.col(at) if sign > 0 else F.col(at) - ((1 << k) - 1)
        more = F.col(words) + F.get(f"s{k}", sum_at)
        d = d.withColumn("_more", F.when(more < min_words, more))
        d = d.withColumns({at: F.when(F.col("_more").isNotNull(), F.col(at) + sign * (1 << k)).otherwise(F.col(at)), words: F.coalesce("_more", words)})
    return d


def _least_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """A row for each line i, with e, the last line of the shortest run of ``min_words`` words from it on (null: there
    is none), and ``chosen``, the line of least rank in that run, the first if there are several.

    The rank is a line's hash without its sign, long lines before short ones.
    """
    d = lines.where(F.size("n") > 0).withColumn("s0", F.col("n"))
    for k in range(1, (min_words - 1).bit_length()):
        before = F.col(f"s{k - 1}")
        d = d.withColumn(f"s{k}", F.zip_with(before, F.slice(before, (1 << k - 1) + 1, F.size("n")), lambda a, b: a + b))
    d = d.withColumn("rank", F.zip_with("h", "n", lambda h, n: F.shiftrightunsigned(h, 2) + F.when(n < LONG_LINE, F.lit(1 << 62)).otherwise(0)))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.size("n") - 1)).alias("i"))
    d = _steps(d.withColumn("e", F.col("i")), "e", 1, min_words).withColumn("e", F.when(F.get("n", F.col("e")).isNotNull(), F.col("e")))
    d = d.withColumn("_run", F.slice("rank", F.col("i") + 1, F.coalesce("e", "i") - F.col("i") + 1))
    d = d.withColumn("_least", F.array_min("_run"))
    return d.withColumn("chosen", F.when(F.col("e").isNotNull(), F.col("i") + F.array_position("_run", F.col("_least")).cast("int") - 1))


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """The chosen lines of all shortest runs: (doc, row, chosen, key), each once."""
    d = _steps(_least_runs(lines, min_words).withColumn("e1", F.col("i") - 1), "e1", 1, min_words)
    # the run from the line before on chose the same line if it holds that line, and its first line ranks behind it
    same = (F.col("i") > 0) & (F.col("e1") >= F.col("chosen")) & (F.get("rank", F.col("i") - 1) > F.col("_least"))
    one = F.when(F.col("chosen").isNotNull() & ~same, F.struct("chosen", F.col("_least").alias("key")))
    return d.select("doc", "row", F.explode(F.array(one)).alias("r")).where("r is not null").select("doc", "row", "r.chosen", "r.key")


def repeated_runs(lines: DataFrame, tables: Tables, min_words: int = 30) -> DataFrame:
    """Runs of lines that occurred before: (doc, row, runs: array of (start, end), removed_lines, removed_words).

    ``lines`` has one row a text: that of its first document.
    """
    f = tables.put(fingerprints(lines, min_words))
    # lines chosen in two places or more: only around these can a run be repeated
    repeated = tables.put(f.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"))
    hits = f.join(repeated.hint("shuffle_hash"), "key").groupBy("doc", "row").agg(F.collect_set("chosen").alias("chosen_ones"))
    near = tables.put(lines.join(hits, ["doc", "row"]))
    tables.drop(f, repeated)
    d = _steps(_least_runs(near, min_words).withColumn("b", F.col("i")), "b", -1, min_words)
    # the shortest run up to i is also that from its own first line on, unless it holds enough words without line i
    d = d.withColumn("b", F.when(F.col("b_words") + F.get("n", F.col("b")) - F.get("n", F.col("i")) >= min_words, F.col("b")))
    on = F.when(F.array_contains("chosen_ones", F.col("chosen")), F.struct(F.col("i").alias("start"), F.col("e").alias("end")))
    up = F.when(F.col("b").isNotNull(), F.struct(F.col("b").alias("start"), F.col("i").alias("end")))
    runs = d.select("doc", "row", "h", F.explode(F.array(on, up)).alias("r")).where("r is not null")
    runs = tables.put(runs.select("doc", "row", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.expr("xxhash64(slice(h, r.start + 1, r.end - r.start + 1))").alias("key")))
    first = tables.put(runs.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct("doc", "row", "start")).alias("first")).where("times > 1").select("key", "first"))
    m = runs.join(first.hint("shuffle_hash"), "key").where(F.struct("doc", "row", "start") > F.col("first"))
    m = tables.put(m.groupBy("doc", "row", "start").agg(F.max("end").alias("end")))
    tables.drop(runs, first)
    w = Window.partitionBy("doc", "row").orderBy("start")
    m = m.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)))
    m = m.withColumn("run", F.count_if("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = m.groupBy("doc", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    words = F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + F.aggregate(F.slice("n", r["start"] + 1, r["end"] - r["start"] + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    count = F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + r["end"] - r["start"] + 1)
    place = lambda i: F.coalesce(F.get("at", i), i)
    placed = F.transform("runs", lambda r: F.struct(place(r["start"]).alias("start"), place(r["end"]).alias("end")))
    found = runs.join(near.select("doc", "row", "n", "at"), ["doc", "row"])
    return found.select("doc", "row", placed.alias("runs"), count.alias("removed_lines"), words.alias("removed_words"))


def dedup_lines(docs: DataFrame, min_words: int = 30) -> DataFrame:
    """The columns of ``docs`` with text cut down, and n_lines, removed_lines and removed_words.

    A line ends at a new line or after a sentence mark and a blank; lines are compared without outer blanks, and
    blank ones are passed over (those inside a deleted run go with it). Every repeated run of whole lines with at
    least ``min_words`` words is the union of the shortest such runs inside it, from each line on and up to each line.
    Of each shortest run the line of least hash is its fingerprint (winnowing: two equal runs choose the same line).
    Around fingerprints that occur twice, the shortest runs are hashed whole and compared with the first place of the
    same run in the order of (doc_id, hash of the text, position); all others are deleted, the first occurrence stays.
    A text that an earlier document has too goes as a whole if it has ``min_words`` words. n_chars, where there is
    one, is set to the new length.

    Null texts stay null and empty ones empty (n_lines 0); a null doc_id comes last in order; rows that are equal in
    doc_id and text are one occurrence and are treated alike; long texts are lines like others, of any number; an
    empty table gives an empty one; extra columns pass through under any name, with n_lines, removed_lines and
    removed_words replaced if they exist.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    all_lines = tables.put(line_table(docs))
    # one row a text, that of its first document; texts of one row only are let through without a shuffle
    rows = all_lines.select("doc", "row").groupBy("row").agg(F.min("doc").alias("first_doc"), F.count("*").alias("times"))
    copied = tables.put(rows.where("times > 1").select("row", "first_doc"))
    apart = sifted(all_lines, F.col("row"), sieve(copied, "row"))
    # stored, so that the join has a stage of its own, in which Spark can split the rows of one text
    maybe = tables.put(apart.where("_may").drop("_may").join(copied.hint("shuffle_hash"), "row", "left"))
    firsts = maybe.where("first_doc is null or doc = first_doc").drop("first_doc").dropDuplicates(["doc", "row"])
    lines = apart.where("not _may").drop("_may").unionByName(firsts)
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    copies = maybe.where("doc > first_doc").select("doc", "row", total.alias("words"), F.size("n").cast("long").alias("removed_lines"), F.col("n_lines").cast("int").alias("n_all")).dropDuplicates(["doc", "row"])
    nonblank = copies.where(F.col("words") >= min_words)
    gone = nonblank.select("doc", "row", F.array(F.struct(F.lit(0).alias("start"), (F.col("n_all") - 1).alias("end"))).alias("runs"), "removed_lines", F.col("words").alias("removed_words"))
    found = tables.put(repeated_runs(lines, tables, min_words).unionByName(gone))

    new = ("n_lines", "removed_lines", "removed_words")
    given = [c for c in docs.columns if c not in new]
    keyed = docs.select(F.struct(*given).alias("it"), F.col("text").alias("text"), *_order())
    keyed = sifted(keyed, F.xxhash64("doc", "row"), sieve(found.select(F.xxhash64("doc", "row").alias("place")), "place"))
    same = keyed.where("not _may").select("it", "text", F.lit(None).cast(found.schema["runs"].dataType).alias("runs"), _n_lines(F.col("text")).alias("n_lines"), *[F.lit(0).cast("long").alias(c) for c in new[1:]])
    touched = keyed.where("_may").select("it", "text", "doc", "row").join(found.hint("shuffle_hash"), ["doc", "row"], "left")
    touched = touched.withColumn("lines", _lines(F.col("text")))
    kept = F.array_join(F.filter("lines", lambda x, i: ~F.exists("runs", lambda r: (i >= r["start"]) & (i <= r["end"]))), "")
    touched = touched.select("it", F.when(F.col("runs").isNotNull(), kept).otherwise(F.col("text")).alias("text"), "runs", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in new[1:]])
    cols = {c: F.col("it").getField(c) for c in given} | {"text": F.col("text")}
    if "n_chars" in given:
        cols["n_chars"] = F.when(F.col("runs").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("it.n_chars"))
    return touched.unionByName(same).select(*[v.alias(c) for c, v in cols.items()], *new)
