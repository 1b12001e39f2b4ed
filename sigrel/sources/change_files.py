"""Change logs in VCD text files: read into variables and changes, and written from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import neighbour

# What the format allows.
KINDS = ("event", "integer", "parameter", "real", "reg", "supply0", "supply1", "time", "tri", "triand", "trior", "trireg", "tri0", "tri1", "wand", "wire", "wor", "bit", "logic", "string")
COMMANDS = ("$comment", "$date", "$version", "$scope", "$upscope", "$timescale", "$var", "$enddefinitions", "$dumpvars", "$dumpall", "$dumpon", "$dumpoff", "$end")

_HEADER = "src string, what string, var_id string, name string, width int, kind string, bit_sel string, text string"


def _located(spark: SparkSession, path: str, parts: bool) -> DataFrame:
    m = F.col("_metadata")
    t = spark.read.text(path).select(m["file_path"].alias("src"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    t = t.where("value <> ''")
    if not parts:
        return t
    # one row a block of a file: the blocks of all part files follow one another
    order = Window.partitionBy("log").orderBy("src", "block")
    blocks = t.select("src", "block").distinct().withColumn("log", F.regexp_replace("src", "/[^/]*$", ""))
    blocks = blocks.withColumn("at", (F.row_number().over(order) - 1).cast("long") * (1 << 27))
    return t.join(F.broadcast(blocks), ["src", "block"]).select(F.col("log").alias("src"), F.col("at").alias("block"), "line", "value")


def _header_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Declarations of header lines sorted by (src, block, line). Of a header, a batch is held, and a command that goes on."""
    src, out, scope, words, ended, seen = None, [], [], [], True, 0

    def parse(whole: bool) -> None:
        nonlocal words, ended, seen
        i = 0
        while i < len(words) and not ended:
            command = words[i]
            if command not in COMMANDS:
                raise ValueError(f"{src}: {command} is not known in a header")
            if command == "$enddefinitions":
                ended = True
                break
            try:
                end = words.index("$end", max(i, seen))
            except ValueError:
                if not whole:
                    break
                end = len(words)
            args = words[i + 1 : end]
            if command == "$scope":
                scope.append(f"{args[0]}:{args[1]}" if args[0] != "module" else args[1])
            elif command == "$upscope":
                scope.pop()
            elif command == "$var":
                if args[0] not in KINDS:
                    raise ValueError(f"{src}: no variable is of type {args[0]}")
                out.append((src, "var", args[2], ".".join([*scope, args[3]]), int(args[1]), args[0], " ".join(args[4:]) or None, None))
            elif command in ("$comment", "$date", "$version", "$timescale"):
                out.append((src, command[1:], None, None, None, None, None, " ".join(args)))
            i = end + 1
        words = [] if ended else words[i:]
        seen = len(words)

    def close() -> None:
        parse(True)
        if not ended:
            raise ValueError(f"{src}: the header doesn't end")

    def rows() -> pd.DataFrame:
        return pd.DataFrame(out, columns=["src", "what", "var_id", "name", "width", "kind", "bit_sel", "text"]).astype({"width": "Int32"})

    for pdf in batches:
        out = []
        for file, lines in pdf.groupby("src", sort=False)["value"]:
            if file != src:
                close()
                src, scope, words, ended, seen = file, [], [], False, 0
            words += " ".join(lines).split()
            parse(False)
        yield rows()
    out = []
    close()
    yield rows()


def read_changes(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All VCD files under ``path``: (files, variables, changes).

    files(src, date, version, comment, timescale); variables(src, var_id, name, width, kind, bit_sel), several names
    may have one var_id; changes(src, t, seq, var_id, raw) with seq its place (block, line) and raw 0, 1, x, z, b<digits> or r<number>. Lines that are
    neither a time nor a change are ignored. The time in force comes in two steps: the last one within a block of the
    file, else the last one of an earlier block, so no window holds a whole file. Times may be out of order. With
    ``parts`` all files of a folder are one log, in the order of their names, as :func:`write_changes` leaves them.
    """
    lines = _located(spark, path, parts)
    # header lines stand before $enddefinitions; its place is one row a file, which the driver has listed
    end = lines.where(F.col("value").startswith("$enddefinitions")).groupBy("src").agg(F.min(F.struct("block", "line")).alias("end"))
    at = F.struct("block", "line")
    placed = lines.join(F.broadcast(end), "src", "left")
    header = placed.where(F.col("end").isNull() | (at <= F.col("end"))).where(F.col("end").isNotNull() | F.col("value").startswith("$"))
    declared = header.select("src", "block", "line", "value").repartition("src").sortWithinPartitions("src", "block", "line").mapInPandas(_header_rows, _HEADER)
    variables = declared.where("what = 'var'").select("src", "var_id", "name", "width", "kind", "bit_sel")
    texts = declared.where("what <> 'var'").groupBy("src").pivot("what", ["date", "version", "comment", "timescale"]).agg(F.last("text"))
    body = placed.where(at > F.col("end")).select("src", "block", "line", "value")
    t = F.regexp_extract("value", r"^#(\d+)$", 1)
    body = body.withColumn("t", F.when(t != "", t.cast("long")))
    # one row a block, which is a task's share of a file at least
    every = body.groupBy("src", "block").agg(F.max_by("t", F.when(F.col("t").isNotNull(), F.col("line"))).alias("last_t"))
    earlier = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("carried", F.last("last_t", ignorenulls=True).over(earlier)).select("src", "block", "carried")
    inside = Window.partitionBy("src", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("here", F.last("t", ignorenulls=True).over(inside))
    body = body.where("t is null").join(F.broadcast(carried), ["src", "block"]).withColumn("t", F.coalesce("here", "carried"))
    scalar, vector = r"^([01xXzZ])(\S+)$", r"^([bBrR]\S+)\s+(\S+)$"
    is_vector = F.col("value").rlike(vector)
    raw = F.when(is_vector, F.regexp_extract("value", vector, 1)).when(F.col("value").rlike(scalar), F.lower(F.regexp_extract("value", scalar, 1)))
    var_id = F.when(is_vector, F.regexp_extract("value", vector, 2)).otherwise(F.regexp_extract("value", scalar, 2))
    changes = body.select("src", "t", F.struct("block", (F.col("line") % (1 << 33)).alias("line")).alias("seq"), var_id.alias("var_id"), raw.alias("raw")).where("raw is not null and t is not null")
    return texts, variables, changes


_FIRST, _RANGE = 33, 94


def variable_id(rank) -> F.Column:
    """Short printable id of a rank: its digits of base 94, from '!' on, as many as it takes."""
    r = (F.col(rank) if isinstance(rank, str) else rank).cast("long")
    powers = F.array(*[F.lit(_RANGE**k) for k in range(9, -1, -1)])  # 94**10 is beyond a long
    digits = F.transform(powers, lambda p: F.char((F.floor(r / p) % _RANGE + _FIRST).cast("int")))
    exact = F.transform(powers, lambda p: F.char((F.floor((r - r % p).cast("decimal(20,0)") / p) % _RANGE + _FIRST).cast("int")))
    return F.regexp_replace(F.array_join(F.when(r < 1 << 53, digits).otherwise(exact), ""), "^!+(?=.)", "")


def write_changes(variables: DataFrame, changes: DataFrame, path: str, timescale: str = "1 ns", comment: str = "", date: str = "", version: str = "", separate: bool = False) -> None:
    """One VCD text (as part files in order) of one source's variables and changes.

    Ids are given by rank of the variables, names of one variable share its id; reals have six decimals; vectors are
    filled up to their width; times are in order and have no empty chunks; the scope tree is sorted by name. With
    ``separate`` a blank line stands before each time, which readers pass over.
    """
    spark = changes.sparkSession
    firsts = variables.groupBy("var_id").agg(F.min("name").alias("root"), F.max("width").alias("width"), F.min("kind").alias("kind"))
    ids = firsts.withColumn("new_id", variable_id(F.row_number().over(Window.orderBy("root", "var_id")) - 1))
    named = variables.join(ids.select("var_id", "new_id"), "var_id").withColumn("name", F.expr("coalesce(name, raise_error('a variable has no name'))"))
    place = changes.schema["seq"].dataType
    none = F.lit(None).cast(place).alias("seq")
    head = [f"${word} {text} $end" for word, text in (("comment", comment), ("date", date), ("version", version), ("timescale", timescale)) if text]
    head = spark.createDataFrame(list(enumerate(head)), "at int, value string").select(F.lit(-1).cast("long").alias("t"), F.lit(-3).alias("part"), F.lit(None).cast("string").alias("name"), "at", none, "value")
    scope_of = lambda c: F.slice(F.split(c, r"\."), 1, F.size(F.split(c, r"\.")) - 1)
    # of each name: what to leave and to enter after the name before; the last scopes are left before the header's end
    steps = named.select("name").distinct().select("name", F.coalesce(scope_of(F.lag("name").over(Window.orderBy("name"))), F.array().cast("array<string>")).alias("was"), scope_of(F.col("name")).alias("scope"))
    differs = F.array_position(F.zip_with("scope", "was", lambda a, b: a.eqNullSafe(b)), False)
    steps = steps.withColumn("same", F.when(differs > 0, differs - 1).otherwise(F.size("scope")).cast("int"))
    up = lambda n: F.array_repeat(F.lit("$upscope $end"), n.cast("int"))
    last = lambda p: F.substring_index(p, ":", -1)
    kind_of = lambda p: F.coalesce(F.nullif(F.left(p, F.greatest(F.lit(0), F.length(p) - F.length(last(p)) - 1)), F.lit("")), F.lit("module"))
    enter = F.transform(F.slice("scope", F.col("same") + 1, F.size("scope")), lambda p: F.concat(F.lit("$scope "), kind_of(p), F.lit(" "), last(p), F.lit(" $end")))
    filled = lambda c: F.nullif(c, F.lit(""))
    declare = F.concat_ws(" ", F.lit("$var"), filled(F.col("kind")), F.coalesce(F.col("width").cast("string"), F.lit("None")), "new_id", filled(F.element_at(F.split("name", r"\."), -1)), filled(F.col("bit_sel")), F.lit("$end"))
    # the header's size is that of the variable list, whatever the log's length
    header = lambda df, part, name, lines: df.select(F.lit(-1).cast("long").alias("t"), F.lit(part).alias("part"), name.alias("name"), F.posexplode(lines).alias("at", "value")).select("t", "part", "name", "at", none, "value")
    head = head.unionByName(header(steps, -2, F.col("name"), F.concat(up(F.size("was") - F.col("same")), enter)))
    head = head.unionByName(named.select(F.lit(-1).cast("long").alias("t"), F.lit(-2).alias("part"), "name", F.lit((1 << 31) - 1).alias("at"), none, declare.alias("value")))
    ending = F.concat(up(F.coalesce(F.size(scope_of(F.col("name"))), F.lit(0))), F.array(F.lit("$enddefinitions $end")))
    head = head.unionByName(header(named.agg(F.max("name").alias("name")), -1, F.lit(None).cast("string"), ending))
    c = changes.join(ids.select("var_id", "new_id", "width", "kind"), "var_id")
    digits = F.regexp_replace("raw", "^[bB]", "")
    fill = F.when(F.substring(digits, 1, 1).isin("x", "z"), F.substring(digits, 1, 1)).otherwise(F.lit("0"))
    wide = F.concat(F.lit("b"), F.repeat(fill, F.greatest(F.lit(0), F.col("width") - F.length(digits))), digits, F.lit(" "), F.col("new_id"))
    text = F.when(F.col("kind") == "real", F.concat(F.format_string("r%.6f", F.regexp_replace("raw", "^[rR]", "").cast("double")), F.lit(" "), F.col("new_id"))).when(F.col("width") <= 1, F.concat(digits, F.col("new_id"))).otherwise(wide)
    unnamed = F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("at")
    rows = c.select("t", F.lit(2).alias("part"), *unnamed, "seq", text.alias("value"))
    times = changes.select("t").distinct().select("t", F.lit(1).alias("part"), *unnamed, none, F.concat(F.lit("\n#" if separate else "#"), F.col("t").cast("string")).alias("value"))
    head.unionByName(times).unionByName(rows).repartitionByRange("t").sortWithinPartitions("t", "part", "name", "at", "seq").select("value").write.mode("overwrite").text(path)


#: Ticks of a segment of stored measures.
SEGMENT = 1 << 20


def store_measures(intervals: DataFrame, path: str, every: int = SEGMENT) -> None:
    """Change points (mtype, signal, t, v) that really change, by type and segment of ``every`` ticks, sorted by (signal, t).

    Values are 0 at first. Each segment also holds a snapshot: the value of each signal at its start, where that isn't 0;
    so what is read for a range of time lies in the segments of that range. A snapshot has a row a signal.
    """
    keys = ["mtype", "signal"]
    real = neighbour(intervals.withColumn("v", F.col("v").cast("double")), "v", "_b", "t", keys).where("v <> coalesce(_b, 0)").drop("_b")
    of = F.floor(F.col("t") / every)
    real = real.withColumn("segment", of)
    last = intervals.agg(F.max(of)).first()[0] or 0  # one number: where the last segment ends
    until = neighbour(real, "segment", "_s", "t", keys, ahead=True).withColumn("_s", F.coalesce("_s", F.lit(last)))
    held = until.where("v <> 0 and _s > segment").select("mtype", "signal", "v", F.explode(F.sequence(F.col("segment") + 1, "_s")).alias("segment"))
    held = held.select("mtype", "signal", (F.col("segment") * every).alias("t"), "v", "segment", F.lit(True).alias("snapshot"))
    both = real.select("mtype", "signal", "t", "v", "segment", F.lit(False).alias("snapshot")).unionByName(held).withColumn("every", F.lit(every).cast("long"))
    both.repartition("mtype", "segment", "signal").sortWithinPartitions("mtype", "segment", "signal", "t").write.mode("overwrite").partitionBy("mtype", "every", "segment").parquet(path)


def load_measures(spark: SparkSession, path: str, names: list[str] | None = None, start: int | None = None, finish: int | None = None) -> DataFrame:
    """Change points of some signals in [start, finish), with those before start carried to it: (signal, t, v, mtype).

    Filters on segments and names reach the scan; with ``start`` nothing before its segment is read. After the last
    change, values stay as they are.
    """
    df = spark.read.schema("signal string, t long, v double, snapshot boolean, mtype string, every long, segment long").parquet(path)
    if names is not None:
        df = df.where(F.col("signal").isin(names))
    if finish is not None:
        df = df.where((F.col("t") < finish) & (F.col("segment") <= F.floor(F.lit(finish - 1) / F.col("every"))))
    columns = ["signal", "t", "v", "mtype"]
    if start is None:
        return df.where("not snapshot").select(columns)
    # the last segment there is, from the names of the files that Spark has listed
    last = max((int(m[1]) for f in df.inputFiles() if (m := re.search(r"segment=(-?\d+)", f))), default=0)
    first = F.least(F.floor(F.lit(start) / F.col("every")), F.lit(last))
    before = df.where((F.col("segment") == first) & (F.col("t") <= start)).groupBy("mtype", "signal").agg(F.max_by("v", F.struct("t", ~F.col("snapshot"))).alias("v")).where("v <> 0")
    after = df.where((F.col("segment") >= first) & (F.col("t") > start) & ~F.col("snapshot"))
    return after.select(columns).unionByName(before.select("signal", F.lit(start).cast("long").alias("t"), "v", "mtype"))
