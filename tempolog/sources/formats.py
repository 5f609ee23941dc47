"""Text forms of traces and verdicts, read and written with DataFrame expressions.

A database trace has lines `@ts rel(a,b)(c,d) other() ...`, one time-point each; a comma-separated trace lines
`rel, tp=N, ts=N, x0=v, ...`; an event trace lines `rel,a,b[,ts]`, each its own time-point. Facts are rows
(tp, ts, rel, args array<string>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import PLACES, numbered, so_far

_VALUE = r'(?:"[^"]*"|[0-9A-Za-z_\[\]/:\-.!]+)'
_SIMPLE = r"^[0-9A-Za-z_\[\]/:\-.!]+$"


def _unquoted(c: Column) -> Column:
    return F.when(c.startswith('"'), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def quoted(c: Column) -> Column:
    return F.when(c.rlike(_SIMPLE), c).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


_COMMAND = r'>\s*((?:[^<"]|"[^"]*")*)<'
_TUPLE = rf"\(\s*(?:{_VALUE}\s*(?:,\s*{_VALUE}\s*)*)?\)"
_DATABASE = rf"^\s*\d+(?:\s*[\w\[\]/:\-.!]+\s*(?:{_TUPLE}\s*)*)*\s*$"


def _unquoted_split(c: Column, sign: str) -> Column:
    """Cut at a sign that doesn't stand between quotes."""
    return F.when(c.contains('"'), F.split(c, sign + r'(?=(?:[^"]*"[^"]*")*[^"]*$)')).otherwise(F.split(c, sign))


def _databases(lines: DataFrame, text: str, order: str) -> DataFrame:
    """(db, body) of a stream of lines: what stands between one @ and the next, a semicolon or a command, over any number of lines.

    Neither comments nor quoted values hold an @ that counts."""
    plain = F.col(text)
    body = F.when(plain.contains("#"), F.regexp_replace(text, r'(?m)^((?:[^#"]|"[^"]*")*)#.*$', "$1")).otherwise(plain)
    body = F.when(body.contains(">"), F.regexp_replace(body, _COMMAND, ";")).otherwise(body)
    pieces = lines.select(F.col(order).alias("line"), _unquoted_split(body, "@").alias("pieces"))
    pieces = so_far(pieces, F.size("pieces") - 1, "sum", F.floor(F.col("line") / PLACES), ["line"], "_before")
    pieces = pieces.select("line", F.coalesce("_before", F.lit(0)).alias("before"), F.posexplode("pieces").alias("i", "piece")).withColumn("db", F.col("before") + F.col("i") - 1)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "i", "piece"))), lambda x: x["piece"]), "\n")
    return pieces.filter("db >= 0").groupBy("db").agg(whole.alias("body"))


def read_database_trace(lines: DataFrame, text: str = "value", order: str = "pos", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(facts, timepoints) of a trace in the form @ts rel(a,b)(c,d) other() ..., of rows with a line number (`order`).

    A database ends at the next @, at a semicolon, at a command or at the end, and may span lines. One that can't be read is
    left out as a whole, with its time-point; with `strict` the query fails."""
    parts = _databases(lines, text, order).select("db", _unquoted_split(F.col("body"), ";").alias("p"))
    good = F.col("p")[0].rlike(_DATABASE) & ~F.exists(F.slice("p", 2, 1 << 30), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("can't read @"), F.array_join("p", ";"))).cast("boolean"))
    rows = numbered(parts.filter(good).select("db", F.col("p")[0].alias("line")), "db", "tp").withColumn("ts", F.regexp_extract("line", r"^\s*(\d+)", 1).cast("bigint"))
    groups = rows.select("tp", "ts", F.explode(F.regexp_extract_all(F.regexp_replace("line", r"^\s*\d+", ""), F.lit(rf"([\w\[\]/:\-.!]+\s*(?:{_TUPLE}\s*)*)"), F.lit(1))).alias("g"))
    rel = F.regexp_extract("g", r"^([^\s(]+)", 1)
    tuples = groups.select("tp", "ts", rel.alias("rel"), F.explode(F.regexp_extract_all(F.regexp_replace("g", r"^[^\s(]+", ""), F.lit(rf"({_TUPLE})"), F.lit(1))).alias("a"))
    args = F.transform(F.regexp_extract_all("a", F.lit(f"({_VALUE})"), F.lit(1)), _unquoted)
    return tuples.select("tp", "ts", "rel", args.alias("args")), rows.select("tp", "ts")


def read_commands(lines: DataFrame, text: str = "value", order: str = "pos") -> DataFrame:
    """(pos, name, args) of the commands >name arg "quoted arg"< in a trace of either form."""
    found = lines.select(F.col(order).alias("pos"), F.explode(F.regexp_extract_all(text, F.lit(_COMMAND), F.lit(1))).alias("c"))
    words = F.transform(F.regexp_extract_all("c", F.lit(r'([^<" ]+|"[^"]*")'), F.lit(1)), _unquoted)
    return found.select("pos", words.alias("w")).filter(F.size("w") > 0).select("pos", F.col("w")[0].alias("name"), F.slice("w", 2, 1 << 30).alias("args"))


def write_database_trace(facts: DataFrame, timepoints: DataFrame) -> DataFrame:
    """(tp, line) with a line for every time-point, relations and tuples in order."""
    one = F.concat(F.lit("("), F.array_join(F.transform("args", quoted), ","), F.lit(")"))
    per = facts.groupBy("tp", "rel").agg(F.array_join(F.sort_array(F.collect_list(one)), "").alias("t"))
    per = per.groupBy("tp").agg(F.array_join(F.sort_array(F.collect_list(F.concat("rel", "t"))), " ").alias("body"))
    return timepoints.join(per, "tp", "left").select("tp", F.concat_ws(" ", F.concat(F.lit("@"), "ts"), "body").alias("line"))


_FACT = r"^[^,>]+,[^,=]*=\s*-?\d+\s*,[^,=]*=\s*-?\d+\s*(?:,[^,=]*=[^,]*)*$"


def read_csv_trace(lines: DataFrame, text: str = "value", strict: bool = False) -> DataFrame:
    """Facts of a comma-separated trace. Argument names don't count; empty lines, ;; and commands give no facts.

    Lines that can't be read are left out; with `strict` the query fails."""
    line = F.trim(F.regexp_replace(text, r"[\r\n]", ""))
    good = line.rlike(_FACT)
    if strict:
        good = F.when(good, True).when(line.isin("", ";;") | line.startswith(">"), False).otherwise(F.raise_error(F.concat(F.lit("can't read "), line)).cast("boolean"))
    cells = F.transform(F.split(line, ","), lambda c: F.trim(c))
    values = F.transform(cells, lambda c: F.trim(F.regexp_replace(c, r"^[^=]*=", "")))
    return lines.filter(good).select(values[1].try_cast("bigint").alias("tp"), values[2].try_cast("bigint").alias("ts"), cells[0].alias("rel"), F.slice(values, 4, F.size(values)).alias("args"))


def terminators(lines: DataFrame, mode: str = "all", text: str = "value", order: str = "pos") -> DataFrame:
    """(pos, tp, ts): the time-points that a comma-separated trace closes, each with the number of the line before which, or
    as which, it does.

    A fact closes the one before it if its time-stamp differs (`timestamps`) or its time-point (`all`); ;; and commands close
    what is open, as the end does (pos null). `none`: only those do."""
    if mode not in ("all", "timestamps", "none"):
        raise ValueError(f"mode {mode!r}")
    line = F.trim(F.regexp_replace(text, r"[\r\n]", ""))
    fact = line.rlike(_FACT)
    value = lambda i: F.trim(F.regexp_extract(line, r"^[^,]*,[^=]*=([^,]*),[^=]*=([^,]*)", i)).try_cast("bigint")
    rows = lines.select(F.col(order).cast("bigint").alias("pos"), fact.alias("fact"), F.when(fact, value(1)).alias("tp"), F.when(fact, value(2)).alias("ts"), ((line == ";;") | line.startswith(">")).alias("stop"))
    rows = rows.filter("fact OR stop")
    last = F.struct(F.col("pos"), F.col("fact"), F.col("tp"), F.col("ts"))
    rows = so_far(rows, last, "max", F.floor(F.col("pos") / PLACES), ["pos"], "before")
    open_ = F.col("before.fact") & F.coalesce(F.col("before.fact"), F.lit(False))
    changed = F.lit(False) if mode == "none" else F.col("ts") != F.col("before.ts") if mode == "timestamps" else (F.col("ts") != F.col("before.ts")) | (F.col("tp") != F.col("before.tp"))
    closed = rows.filter(open_ & (F.col("stop") | F.coalesce(changed, F.lit(False)))).select("pos", F.col("before.tp").alias("tp"), F.col("before.ts").alias("ts"))
    end = rows.agg(F.max(last).alias("l")).filter("l.fact").select(F.lit(None).cast("bigint").alias("pos"), F.col("l.tp").alias("tp"), F.col("l.ts").alias("ts"))
    return closed.union(end)


def write_csv_trace(facts: DataFrame, renumber: bool = False, closing: bool = False) -> DataFrame:
    """(tp, line). renumber: time-points from 0 without gaps. closing: a line ;; after each time-point's facts."""
    if renumber:
        points = numbered(facts.select("tp").distinct(), "tp", "_new")
        facts = facts.join(points, "tp").drop("tp").withColumnRenamed("_new", "tp")
    args = F.transform("args", lambda x, i: F.concat(F.lit("x"), i.cast("string"), F.lit("="), x))
    head = F.array(F.col("rel"), F.concat(F.lit("tp="), "tp"), F.concat(F.lit("ts="), "ts"))
    out = facts.select("tp", F.array_join(F.concat(head, args), ", ").alias("line"))
    return out.union(facts.select("tp").distinct().select("tp", F.lit(";;"))) if closing else out


def read_event_trace(lines: DataFrame, timed: bool = False, text: str = "value", order: str = "pos") -> DataFrame:
    """Facts of an event trace; the last cell is the time-stamp if timed, else it is 0."""
    cells = F.transform(F.split(text, ","), lambda c: F.trim(c))
    rows = numbered(lines.filter(F.length(F.trim(text)) > 0), order, "tp")
    n = F.size(cells)
    ts = F.element_at(cells, -1).cast("bigint") if timed else F.lit(0).cast("bigint")
    return rows.select("tp", ts.alias("ts"), cells[0].alias("rel"), F.slice(cells, F.lit(2), n - (2 if timed else 1)).alias("args"))


def write_event_trace(facts: DataFrame, timed: bool = False) -> DataFrame:
    """(tp, line). The form has one event for each time-point: more than one fails."""
    cells = F.concat(F.array("rel"), F.col("args"))
    line = F.array_join(F.concat(cells, F.array(F.col("ts").cast("string"))) if timed else cells, ",")
    per = facts.select("tp", line.alias("line")).groupBy("tp").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return per.select("tp", F.when(F.col("n") == 1, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("several events at time-point "), "tp")).cast("string")).alias("line"))


def linearised(facts: DataFrame) -> DataFrame:
    """A time-point for every fact, by time-point, relation and arguments; facts that repeat count each. Any form can be
    written from it."""
    return numbered(facts, "tp", "_new", ["rel", F.array_join("args", "\x00")], 4096).drop("tp").withColumnRenamed("_new", "tp")


def verdict_lines(verdicts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(tp, line): `@ts. (time point N): (v1,v2)(...)`, or `true` without variables."""
    if not names:
        return verdicts.select("tp", F.concat(F.lit("@"), "ts", F.lit(". (time point "), "tp", F.lit("): true")).alias("line"))
    one = F.concat(F.lit("("), F.concat_ws(",", *[quoted(F.col(n).cast("string")) for n in names]), F.lit(")"))
    per = verdicts.groupBy("tp", "ts").agg(F.array_join(F.sort_array(F.collect_list(one)), "").alias("body"))
    return per.select("tp", F.concat(F.lit("@"), "ts", F.lit(". (time point "), "tp", F.lit("): "), "body").alias("line"))


def read_verdicts(lines: DataFrame, text: str = "value") -> DataFrame:
    """(tp, ts, args) of verdict lines; args is empty for `true`."""
    ts = F.regexp_extract(text, r"^@(\d+)\.", 1).cast("bigint")
    tp = F.regexp_extract(text, r"\(time point (\d+)\)", 1).cast("bigint")
    body = F.regexp_extract(text, r"\): (.*)$", 1)
    rows = lines.filter(F.col(text).rlike(r"^@\d+\. \(time point \d+\):")).select(tp.alias("tp"), ts.alias("ts"), body.alias("body"))
    tuples = F.when(F.trim("body") == "true", F.array(F.lit(""))).otherwise(F.regexp_extract_all("body", F.lit(rf"\(((?:{_VALUE},?)*)\)"), F.lit(1)))
    return rows.select("tp", "ts", F.explode(tuples).alias("t")).select("tp", "ts", F.transform(F.regexp_extract_all("t", F.lit(f"({_VALUE})"), F.lit(1)), _unquoted).alias("args"))


def assignment_lines(verdicts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(tp, line): `@ts : tp (v1, v2)`."""
    values = F.concat(F.lit(" ("), F.concat_ws(", ", *[F.col(n).cast("string") for n in names]), F.lit(")")) if names else F.lit("")
    return verdicts.select("tp", F.concat(F.lit("@"), "ts", F.lit(" : "), "tp", values).alias("line"))
