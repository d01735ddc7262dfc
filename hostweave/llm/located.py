"""Matches of a pattern with their places in code points, by DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of context kept on either side of a match (never beyond the neighbouring match).
CONTEXT = 24


def add_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name a column m_<name>: array of (start, end, text, before, after) of the leftmost non-overlapping matches.

    patterns: name -> (a regular expression that a text with matches satisfies and that is cheap to test, the pattern).
    A match's place follows from the lengths of the pieces between matches. Patterns must not match the empty string.
    """
    found = {f"_f_{n}": F.when(F.col(text).rlike(hint), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for n, (hint, p) in patterns.items()}
    df = df.withColumns(found)
    df = df.withColumns({f"_g_{n}": F.when(F.size(f"_f_{n}") > 0, F.split(text, p, -1)) for n, (_, p) in patterns.items()})
    return df.withColumns({f"m_{n}": _placed(f"_f_{n}", f"_g_{n}") for n in patterns}).drop(*found, *[f"_g_{n}" for n in patterns])


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once in an interpreted lambda."""
    return F.transform(F.array(value), use)[0]


#: Matches that are placed in one fold, and spans that are compared as one. Folds copy what they have gathered, so their length is bounded.
RUN = 64


def _placed(found: str, gaps: str) -> Column:
    """Places by runs of RUN matches: each run's offset is the length of the runs before it."""
    first, after = F.slice(gaps, 1, F.size(found)), F.slice(gaps, 2, F.size(found))
    steps = F.arrays_zip(F.col(found).alias("m"), first.alias("g"), after.alias("a"))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,text:string,before:string,after:string>>)")
    length = lambda acc, s: acc + F.length(s["g"]) + F.length(s["m"])

    def one(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["g"])
        end = start + F.length(s["m"])
        placed = F.struct(start.alias("start"), end.alias("end"), s["m"].alias("text"), F.right(s["g"], F.lit(CONTEXT)).alias("before"), F.left(s["a"], F.lit(CONTEXT)).alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["done"], placed).alias("done"))

    def cut(all_steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / RUN).cast("int")), lambda k: F.slice(all_steps, k * RUN + 1, F.lit(RUN)))

    def place(runs: Column) -> Column:
        offsets = F.aggregate(runs, F.array(F.lit(0)), lambda acc, run: F.array_append(acc, F.aggregate(run, F.element_at(acc, -1), length)))
        pairs = F.filter(F.arrays_zip(runs.alias("run"), offsets.alias("at")), lambda x: x["run"].isNotNull())
        return F.flatten(F.transform(pairs, lambda x: F.aggregate(x["run"], F.struct(x["at"].alias("at"), empty.alias("done")), one)["done"]))

    return F.when(F.size(found) > 0, let(let(steps, cut), place)).otherwise(empty)


def apart(rows: DataFrame, mine: str, others: str, standing: Callable[[Column], Column], free: Callable[[Column], Column]) -> DataFrame:
    """Drops from the array `mine` the spans that overlap a standing one of `others`, except those that are free to.

    Spans of an array are disjoint and by start. Others are taken in runs of RUN, and only runs that reach a span are
    looked into, so that long texts with many spans don't compare all with all.
    """
    cut = lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda k: F.slice(x, k * RUN + 1, F.lit(RUN))))
    runs = F.transform(let(F.filter(others, standing), cut), lambda r: F.struct(r[0]["start"].alias("low"), F.element_at(r, -1)["end"].alias("high"), r.alias("spans")))
    meets = lambda s: F.exists("_runs", lambda r: (r["low"] < s["end"]) & (s["start"] < r["high"]) & F.exists(r["spans"], lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
    kept = F.filter(mine, lambda s: free(s) | ~meets(s))
    return rows.withColumn("_runs", runs).withColumn(mine, F.when(F.col("_runs").isNull(), F.col(mine)).otherwise(kept)).drop("_runs")
